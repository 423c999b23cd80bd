"""Counts of 64-bit hashes over a whole table of texts, without a JVM row for each.

Each slice of texts sends its hashes as one sorted array for each range of hash values. Ranges are as many as the texts
need to be about COUNT_BYTES of text each, so a range is counted in memory, whatever the table's size, and a task counts
about two ranges, one after the other; a hash that stands in every slice is one number of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_slices

#: Text whose hashes are counted in one piece, about.
COUNT_BYTES = 8 << 20
TOTALS = -1


def range_counts(texts: DataFrame, count: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[int]]], more_than: int) -> DataFrame:
    """hash and n of every hash that occurs more than more_than times in the rows of texts (one string column), part >= 0;
    and where part is TOTALS, the sums (n) of the further numbers that count gives, by their place (hash).

    count(texts) gives the distinct hashes of a slice in ascending order, how often each occurs, and further numbers."""
    (column,) = texts.columns
    parts = 1 + int(texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]) // COUNT_BYTES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column, 4 << 20):
                h, c, totals = count(part.column(0))
                which = (h >> np.uint64(32)).astype(np.int64) * parts >> 32  # ascends with the hashes
                cuts = np.searchsorted(which, np.arange(parts + 1))
                held = np.flatnonzero(np.diff(cuts))
                hashes, times = ([v[cuts[k] : cuts[k + 1]].tobytes() for k in held] for v in (h, c.astype(np.int32)))
                hashes.append(np.arange(len(totals), dtype=np.uint64).tobytes())
                times.append(np.array(totals, np.int32).tobytes())  # of a slice, as all counts here
                del h, c, which
                yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), TOTALS]), pa.array(hashes, pa.binary()), pa.array(times, pa.binary())], names=["part", "hashes", "times"])
        release()

    def total(k: int, found: list) -> pa.RecordBatch:
        h, c = (np.concatenate(v) for v in zip(*found, strict=True))
        found.clear()
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        n = np.add.reduceat(c, first, dtype=np.int64) if len(h) else c.astype(np.int64)
        many = n > (more_than if k >= 0 else -1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(many.sum()), k)), pa.array(h[first][many].view(np.int64)), pa.array(n[many])], names=["part", "hash", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, []  # parts come one after another, so one is held at a time
        for batch in batches:
            for k, h, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if found and k != part:
                    yield total(part, found)
                    found = []
                part = k
                found.append((np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int32)))
        if found:
            yield total(part, found)
        release()

    return texts.mapInArrow(send, "part long, hashes binary, times binary").repartition(1 + parts // 2, "part").sortWithinPartitions("part").mapInArrow(add, "part long, hash long, n long")


def most_frequent(counted: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a stored table (hash, n): as many whole classes of counts (eighths of a doubling), the highest
    first, as have at most `room` rows of 16 bytes together."""
    classed, least = counted.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), 1 << 20
    for k, c in sorted(((r["class"], r["count"]) for r in classed.groupBy("class").count().collect()), reverse=True):
        if c > room:
            break
        least, room = k, room - c
    held = classed.where(F.col("class") >= least).select("hash", "n").toArrow()
    return held.column("hash").to_numpy().view(np.uint64), held.column("n").to_numpy()
