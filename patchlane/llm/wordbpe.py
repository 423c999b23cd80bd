"""BPE encoding and decoding through a table of the corpus's distinct words.

1. Spark splits the texts into words (runs between ASCII white space, which such tokenizers drop and never cross) and
   counts the distinct ones.
2. The most frequent words, at most `frequent` of them and none over MAX_BYTES long, are encoded by the tokenizers library
   and broadcast with their ids: a table of bounded size that covers most occurrences and every word that could be hot.
   The other occurrences, as (row, position, word), are shuffled by their word, where each distinct word is encoded once.
3. The ids come back to their row by position: rows travel once, as compressed word numbers, and are joined with the
   collected (position, ids) of their other words.
4. Decoding joins ids with the broadcast id-to-piece table, whose size is the vocabulary's, and joins the pieces by spaces
   (the library's rule where a tokenizer has no decoder).

Results equal encode(text, add_special_tokens=False) and decode(ids, skip_special_tokens=False) of the whole text.

Defined cases: a null or empty text, or one of white space alone, has no ids and decodes to an empty string; equal rows
each give a row; null identifiers are kept; an empty table gives no rows; further columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .chunkcodec import ChunkEncoder, HashTable, ragged, worker_encoder
from .common import compute_columns, materialize, shared_dir, slices, text_slices

MAX_BYTES = 32
#: Words whose ids and pieces are put together at once; numbers of repeated words compress to nothing, so bytes say little.
SLICE_WORDS = 400_000
SPACES = "[\\x09-\\x0D\\x20]+"
BUCKETS = 8  # of counts, for each doubling


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n (occurrences in all texts) of every distinct word."""
    words = docs.select(F.explode(F.split(F.col(text_col).cast("string"), SPACES)).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def encode_words(words: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of words with their word's ids (binary, little-endian, of the vocabulary's width) in its place."""
    kept = [f for f in words.schema if f.name != "word"]
    schema = T.StructType([*kept, T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = worker_encoder(tokenizer_path, "word").encode(batch.column("word"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), binary(ids, np.diff(ends))], names=schema.names)

    return words.mapInArrow(encode, schema)


def binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    cuts = np.r_[0, np.cumsum(lengths, dtype=np.int64)] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Frequent:
    """Ids of the frequent words, by word hash. Only hashes, lengths and ids travel; each worker makes its own table."""

    def __init__(self, keys: np.ndarray, ids: pa.Array, kind: type):
        flat, cuts = textvec.utf8(ids)
        self.keys, self.flat, self.lengths = keys, flat.view(kind), (np.diff(cuts) // kind().itemsize).astype(np.uint16)
        self.made: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def tables(self) -> tuple[HashTable, np.ndarray, np.ndarray]:
        """Word hash to number, and where a number's ids start and how many they are."""
        if self.made is None:
            table = HashTable(max(len(self.keys), 1))
            table.add(self.keys)
            lengths = self.lengths.astype(np.int32)
            self.made = table, np.cumsum(lengths, dtype=np.int64) - lengths, lengths
        return self.made


def frequent_words(words: DataFrame, tokenizer_path: str, frequent: int, kind: type) -> Frequent:
    """The words of the highest counts, as many whole count classes as have at most `frequent` words; ordered by count."""
    short = words.where(F.octet_length("word") <= MAX_BYTES).withColumn("class", F.floor(F.log2("n") * BUCKETS).cast("int"))
    least, room = 1 << 20, frequent
    for k, n in sorted(((r["class"], r["count"]) for r in short.groupBy("class").count().collect()), reverse=True):  # a class each eighth of a doubling
        if n > room:
            break
        least, room = k, room - n

    # At most `frequent` rows of at most MAX_BYTES each.
    chosen = short.where(F.col("class") >= least).select("n", "word", F.col("word").alias("key"))
    held = encode_words(chosen, tokenizer_path).sort(F.desc("n"), "key").toArrow().combine_chunks()
    if not held.num_rows:
        return Frequent(np.zeros(0, np.uint64), pa.array([], pa.binary()), kind)
    key, ids = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (held.column("key"), held.column("ids")))
    raw, offsets = textvec.utf8(key)
    return Frequent(textvec.hashes(raw, offsets[:-1], offsets[1:]), ids, kind)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """uint32 numbers, their bytes by significance, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 20) -> DataFrame:
    """The id column, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (string) of every row."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    own = ChunkEncoder(tokenizer_path, "word", max_chunks=1)
    kind, vocabulary = own.kind, own.tokenizer.get_vocab_size()
    pieces = spark.sparkContext.broadcast([own.tokenizer.id_to_token(i) or "" for i in range(vocabulary)])
    words = materialize(word_table(docs, text_col), "words", folder)
    known = spark.sparkContext.broadcast(frequent_words(words, tokenizer_path, frequent, kind))

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # Two 64-bit hashes name a row; rows of equal identifier and text have equal results.
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(docs[id_col], text).alias("k1"), F.xxhash64(F.lit("row"), text, docs[id_col]).alias("k2"))

    def numbers_of(texts: pa.Array) -> tuple[np.ndarray, textvec.Spans, np.ndarray]:
        raw, offsets = textvec.utf8(texts)
        spans = textvec.words(raw, offsets)
        return known.value.tables()[0].find(textvec.hashes(raw, spans.start, spans.end)), spans, raw

    def numbered(texts: pa.Array) -> list:
        numbers, spans, _ = numbers_of(texts)
        parts = np.split(numbers.astype(np.int64).astype("<u4"), spans.first[1:-1])
        return [pa.array([pack_numbers(p) if len(p) else None for p in parts], pa.binary()), spans.counts()]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                numbers, spans, raw = numbers_of(part.column("text"))
                at = np.flatnonzero(numbers < 0)
                doc = np.searchsorted(spans.first, at, "right") - 1
                size = spans.end[at] - spans.start[at]
                cuts = np.r_[0, np.cumsum(size)].astype(np.int32)
                word = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(raw[ragged(spans.start[at], size)])])
                key = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("k1").take(key), part.column("k2").take(key), pa.array((at - spans.first[doc]).astype(np.int32)), word], names=["k1", "k2", "pos", "word"])

    others = rows.select("k1", "k2", "text").mapInArrow(rare, "k1 long, k2 long, pos int, word string")
    # A word that is not in the table is rare, or long; long ones may be hot and are dealt by row too.
    dealt = others.repartition("word", F.when(F.octet_length("word") > MAX_BYTES, F.pmod(F.col("k1"), F.lit(64))).otherwise(0))
    placed = encode_words(dealt, tokenizer_path).repartition("k1", "k2").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "ids")).alias("others"))
    packed = compute_columns(rows, "text", ["id", "k1", "k2"], [T.StructField("numbers", T.BinaryType()), T.StructField("words", T.LongType())], numbered)
    joined = packed.join(placed, ["k1", "k2"], "left").select("id", "numbers", "words", "others")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.string())
        for batch in batches:
            for part in slices(batch, batch.column("words").to_numpy(), SLICE_WORDS):
                yield assemble(part, known.value, table, id_col)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)])
    return joined.mapInArrow(finish, schema)


def assemble(part: pa.RecordBatch, known: Frequent, pieces: pa.Array, id_col: str) -> pa.RecordBatch:
    """Ids and decoded texts of some rows from their word numbers and the (position, ids) of their other words."""
    parts = [unpack_numbers(x) if x else np.zeros(0, np.uint32) for x in part.column("numbers").to_pylist()]
    first = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    numbers = np.concatenate([np.zeros(0, np.uint32), *parts])
    open_ = numbers == np.uint32(0xFFFFFFFF)
    numbers = np.where(open_, 0, numbers).astype(np.int64)
    starts, lengths = (x[numbers] if len(x) else np.zeros(len(numbers), np.int64) for x in known.tables()[1:])
    others = part.column("others")
    counts = pc.fill_null(pc.list_value_length(others), 0).to_numpy(zero_copy_only=False)
    values = others.flatten()
    at = np.repeat(first[:-1], counts) + values.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
    flat, cuts = textvec.utf8(values.field("ids"))
    own = flat.view(known.flat.dtype)
    cuts = cuts // own.itemsize
    starts[at], lengths[at] = len(known.flat) + cuts[:-1], np.diff(cuts)
    open_[at] = False
    if open_.any():
        raise RuntimeError(f"{int(open_.sum())} words have no ids")
    ids = np.concatenate([known.flat, own])[ragged(starts, lengths)]
    ends = np.r_[0, np.cumsum(lengths)][first]
    decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pieces.take(pa.array(ids))), " ")
    made = [part.column("id"), pa.array(np.diff(ends)), binary(ids.astype("<u4"), np.diff(ends)), decoded]
    return pa.RecordBatch.from_arrays(made, names=[id_col, "n_tokens", "ids", "decoded"])
