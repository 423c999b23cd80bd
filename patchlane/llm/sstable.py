"""Token ids of documents in sorted-string-table shards, with lookup by identifier.

A shard holds entries in ascending key order. Layout:

* data blocks of about block_bytes: entries with prefix-compressed keys; every RESTART-th entry has its whole key, and the
  block ends with the places of these for a binary search; a block is compressed as one zstandard frame;
* the sparse index: for each block its first key, place, size, and the entries and ids of the shard before it;
* a Bloom filter of all identifiers;
* a footer of fixed size: the places of index and filter, counts, and a magic word.

A key is the identifier as an order-preserving byte string; equal identifiers are told apart by their place. Values are
ids as little-endian unsigned 16- or 32-bit integers.

Rows are dealt by ranges of (identifier, text hash) and sorted in their partition, so shards are ascending among
themselves and a hot identifier is spread by its texts. Shards are written under a hidden name and renamed, so a lost or
repeated task leaves the same files.

Defined cases: a null or empty text has the end id alone; null identifiers come first; equal identifiers are ordered by
the hash of their texts; an empty table has no shard; further columns are not read."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunkcodec import worker_encoder
from .common import materialize, shared_dir, text_slices
from .files import reading, writing
from .textvec import mix

MAGIC = b"PLSST01\n"
#: Places of index and filter, their sizes, entries, ids, blocks, bytes of an id, magic.
FOOTER = struct.Struct("<QQQQQQQQ8s")
INDEX = struct.Struct("<QIQQ")
RESTART = 16
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(identifier: int | None) -> bytes:
    """Bytes that order as identifiers do, null first."""
    return b"\0" if identifier is None else b"\1" + (int(identifier) + (1 << 63)).to_bytes(8, "big")


def identifier_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[:1] == b"\1" else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(identifiers: np.ndarray, bits: int) -> np.ndarray:
    h = mix(identifiers.astype(np.int64).view(np.uint64))
    step = mix(h) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    def __init__(self, out, id_bytes: int, block_bytes: int):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.zip = zstandard.ZstdCompressor(level=3)
        self.place = self.entries = self.ids = 0
        self.index: list[bytes] = []
        self.identifiers: list[int] = []
        self.begin()

    def begin(self) -> None:
        self.parts, self.size, self.restarts, self.count, self.previous = [], 0, [], 0, b""
        self.before = (self.entries, self.ids)

    def add(self, key: bytes, value: bytes) -> None:
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.previous, strict=False)) if a != b), min(len(key), len(self.previous)))
        if not self.count:
            self.first = key
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.parts += (entry, value)
        self.size += len(entry) + len(value)
        self.count, self.previous = self.count + 1, key
        self.entries, self.ids = self.entries + 1, self.ids + len(value) // self.id_bytes
        if self.size >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.count:
            block = b"".join(self.parts) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = self.zip.compress(block)
            self.out.write(data)
            self.index.append(varint(len(self.first)) + self.first + INDEX.pack(self.place, len(data), *self.before))
            self.place += len(data)
            self.begin()

    def close(self, identifiers: np.ndarray) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(identifiers))
        field = np.zeros((bits + 7) // 8 * 8, np.uint8)
        field[bloom_places(identifiers, bits).ravel()] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(field, bitorder="little").tobytes()
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.place, len(index), self.place + len(index), len(bloom), self.entries, self.ids, len(self.index), self.id_bytes, MAGIC))


class Shard:
    """One shard, opened for lookups and scans."""

    def __init__(self, uri: str):
        self.file = reading(uri)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        at, n, self.bloom_at, self.bloom_size, self.entries, self.ids, _, self.id_bytes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        self.file.seek(at)
        raw, i = self.file.read(n), 0
        self.keys, self.blocks = [], []
        while i < n:
            k, i = read_varint(raw, i)
            self.keys.append(raw[i : i + k])
            self.blocks.append(INDEX.unpack_from(raw, i + k))
            i += k + INDEX.size

    def block(self, i: int) -> bytes:
        at, n, _, _ = self.blocks[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(n))

    @staticmethod
    def entries_from(block: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        end = len(block) - 4 * (1 + struct.unpack_from("<I", block, len(block) - 4)[0])
        while at < end:
            shared, at = read_varint(block, at)
            own, at = read_varint(block, at)
            n, at = read_varint(block, at)
            key = key[:shared] + block[at : at + own]
            yield key, block[at + own : at + own + n]
            at += own + n

    def may_hold(self, identifier: int | None) -> bool:
        if identifier is None:
            return True
        self.file.seek(self.bloom_at)
        raw = self.file.read(self.bloom_size)
        bits = struct.unpack_from("<Q", raw)[0]
        return all(raw[8 + int(p) // 8] >> (int(p) % 8) & 1 for p in bloom_places(np.array([identifier]), bits)[0])

    def lookup(self, identifier: int | None) -> list[np.ndarray]:
        """Ids of all entries of an identifier: Bloom filter, binary search of the index, then of the block."""
        prefix, found = key_of(identifier), []
        if not self.keys or not self.may_hold(identifier):
            return found
        i = max(bisect.bisect_left(self.keys, prefix) - 1, 0)
        while i < len(self.keys) and self.keys[i][: len(prefix)] <= prefix:
            block = self.block(i)
            n = struct.unpack_from("<I", block, len(block) - 4)[0]
            restarts = struct.unpack_from(f"<{n}I", block, len(block) - 4 * (n + 1))
            k = max(bisect.bisect_left(restarts, prefix, key=lambda at: next(self.entries_from(block, at))[0]) - 1, 0)
            for key, value in self.entries_from(block, restarts[k]):
                if key[: len(prefix)] > prefix:
                    return found
                if key[: len(prefix)] == prefix:
                    found.append(np.frombuffer(value, f"<u{self.id_bytes}"))
            i += 1
        return found


def write_tables(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, style: str = "byte", block_bytes: int = 1 << 16
) -> DataFrame:
    """Write shards into folder; a row for each: shard, path, entries, ids, blocks. The table itself is stored beside them."""
    schema = "shard int, path string, entries long, ids long, blocks int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = worker_encoder(tokenizer_path, style)
        number = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{number:08d}.sst"
        with writing(uri) as out:
            table = Writer(out, encoder.kind().itemsize, block_bytes)
            seen, place = [], 0
            for batch in _chain(first, batches):
                for part in text_slices(batch, "text"):
                    ids, ends = encoder.encode(part.column("text"))
                    whole = np.insert(ids, ends[1:], end_id).astype(f"<u{table.id_bytes}").tobytes()
                    cuts = ((ends + np.arange(len(ends))) * table.id_bytes).tolist()
                    names = part.column("id")
                    seen.append(names.drop_null().to_numpy(zero_copy_only=False))
                    for name, a, b in zip(names.to_pylist(), cuts, cuts[1:], strict=False):
                        table.add(key_of(name) + place.to_bytes(8, "big"), whole[a:b])
                        place += 1
            table.close(np.concatenate(seen))
        yield pa.RecordBatch.from_pylist(
            [{"shard": number, "path": uri, "entries": table.entries, "ids": table.ids, "blocks": len(table.index)}],
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("blocks", pa.int32())]),
        )

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    return materialize(made, "manifest", folder)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_tables(manifest: DataFrame, id_col: str = "doc_id", blocks_a_read: int = 64) -> DataFrame:
    """All entries of the shards of a manifest: the id column, start (ids before it over all shards), n_tokens, ids
    (binary, little-endian unsigned 32-bit). Reads runs of blocks in parallel; the running sum is over shards only."""
    # Shards are few and their rows tiny, so one window over them is no bottleneck.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", "blocks", before.alias("base")).withColumn("from", F.explode(F.expr(f"sequence(0, blocks - 1, {int(blocks_a_read)})")))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                for i in range(row["from"], row["from"] + row["n"]):
                    start, names, starts, counts, ids = row["base"] + shard.blocks[i][3], [], [], [], []
                    for key, value in shard.entries_from(shard.block(i), 0):
                        names.append(identifier_of(key))
                        starts.append(start)
                        counts.append(len(value) // shard.id_bytes)
                        ids.append(np.frombuffer(value, f"<u{shard.id_bytes}").astype("<u4").tobytes())
                        start += counts[-1]
                    made = [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, names=schema.names)

    parts = shards.select("path", "base", F.least(F.lit(blocks_a_read), F.col("blocks") - F.col("from")).alias("n"), "from")
    spark = manifest.sparkSession
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def store_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs as shards into a new shared folder, and all entries read back."""
    return read_tables(write_tables(docs, tokenizer_path, shared_dir(spark), **options))
