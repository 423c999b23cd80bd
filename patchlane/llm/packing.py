"""Lexical retrieval packing: documents that share rare words fill a training window together.

1. Document frequencies of all words and the mean length are counted over the whole table. The table of the words that two
   or more documents hold (at most `table_terms`, the most frequent ones) is broadcast. Where more words are shared, the
   rest stays a stored table, and each document gets the frequencies of its words among them by a join on the words.
2. Each document gets three keys: words it shares with other documents, drawn by hash so that the chance that two documents
   draw the same one is their Jaccard similarity weighted by squared idf. Rows are dealt by ranges of these keys, so
   documents from any file meet; a key that very many documents draw is spread by the further keys, the id and a draw.
3. Each task cuts its range into shards of about shard_tokens tokens and builds a BM25 inverted index of each shard over the
   shard's words, with the corpus's frequencies and mean length. The first unused document, or the rest of the last one
   cut, seeds a window; the index returns the seed's unused neighbours by falling BM25 score over all its words, which fill
   the window; a neighbour that doesn't fit is cut and its rest seeds the next window. Where the index returns no more, the
   first unused document follows. No token is lost or repeated and every window is full, but for a shard's last: it is cut
   into sequences whose lengths are powers of two, which need no padding.

Neighbours of other shards are not seen: the keys decide which share of them meets (the README has measured shares).
Ids are those of the tokenizer without special tokens, then end_id.

Defined cases: a null or empty text is the end token alone; equal rows are packed each for itself; a null id is kept; an
empty table gives no rows; further columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .chunkcodec import ragged, worker_encoder
from .common import array_slices, drop_table, materialize, release, text_slices
from .counts import TOTALS, most_frequent, range_counts

K1, B = 1.2, 0.75
#: Terms that so large a share of a shard's documents hold are scored from dense rows.
DENSE = 1 / 16
#: Neighbours that a query puts in order at once.
LEADING = 16
#: Columns of a row's words outside the broadcast table: their hashes and their document frequencies.
RARE = ("__rare__", "__held__")


class CorpusTerms:
    """Document frequencies of words, by hash, and the number and mean length (in words) of all documents.

    rest: the words (hash, n) of two or more documents that the table has no room for, stored; None if it has them all."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, n: int, mean: float, rest: DataFrame | None = None):
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.uint64(2**64 - 1)]  # no hash is above the last one
        self.docs = np.r_[docs[order], 0].astype(np.min_scalar_type(int(docs.max(initial=0))))
        self.n, self.mean, self.rest = n, mean, rest
        self.shift = np.uint64(min(65 - len(self.keys).bit_length(), 63))
        self.starts: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"starts": None, "rest": None}

    def frequency(self, keys: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Document frequencies; 0 for words outside the table, and outside more, if given (ascending hashes, frequencies)."""
        if self.starts is None:  # of each range of hashes, there are one or two for each
            ranges = np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift
            self.starts = np.searchsorted(self.keys, ranges).astype(np.int32)
        at = self.starts[(keys >> self.shift).astype(np.int64)]
        left = np.flatnonzero(self.keys[at] < keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < keys[left]]
        out = np.where(self.keys[at] == keys, self.docs[at], 0).astype(np.int64)
        if more is not None and len(more[0]):
            missing = np.flatnonzero(out == 0)
            at = np.minimum(np.searchsorted(more[0], keys[missing]), len(more[0]) - 1)
            out[missing] = np.where(more[0][at] == keys[missing], more[1][at], 0)
        return out


def document_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and row of the distinct words of each row, by row, and the number of all words."""
    keys, rows, at, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    for part in array_slices(texts):
        spans = textvec.words(*(raw := textvec.utf8(part)))
        own, row = textvec.hashes(raw[0], spans.start, spans.end), spans.doc()
        both = textvec.mix(own + row.astype(np.uint64) * textvec.BASE)
        order = np.argsort(both)
        both = both[order]
        first = np.sort(order[np.r_[True, both[1:] != both[:-1]]]) if len(both) else order  # one of each word of a row
        keys.append(own[first])
        rows.append(row[first] + at)
        at, words = at + len(part), words + len(own)
    return np.concatenate(keys), np.concatenate(rows), words


def corpus_terms(docs: DataFrame, table_terms: int) -> CorpusTerms:
    """The frequencies over all rows of docs, whose only column is __text__. The caller drops the stored rest."""

    def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        keys, _, words = document_terms(texts)
        return *np.unique(keys, return_counts=True), [len(texts), words]

    counted = materialize(range_counts(docs, count, 1), "word-counts")
    whole = {r["hash"]: r["n"] for r in counted.where(F.col("part") == TOTALS).collect()}  # two rows
    shared = counted.where("part >= 0").select("hash", "n")
    keys, held = most_frequent(shared, table_terms)
    rest: DataFrame | None = shared.where(F.col("n") < int(held.min())) if len(held) else shared  # the table has whole classes of counts
    if rest.isEmpty():
        drop_table(counted)
        rest = None
    n = whole.get(0, 0)
    return CorpusTerms(keys, held, n, max(whole.get(1, 0) / max(n, 1), 1), rest)


def with_rest(texts: DataFrame, corpus: CorpusTerms, held: Broadcast) -> tuple[DataFrame, DataFrame]:
    """texts with RARE: of each row, its words in corpus.rest and their frequencies; and the stored table that it reads."""
    numbered = materialize(texts.withColumn("__row__", F.monotonically_increasing_id()), "numbered-texts")

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text__"):
                keys, row, _ = document_terms(part.column("__text__"))
                at = np.flatnonzero(held.value.frequency(keys) == 0)
                yield pa.RecordBatch.from_arrays([part.column("__row__").take(pa.array(row[at])), pa.array(keys[at].view(np.int64))], names=["__row__", "hash"])

    words = numbered.select("__row__", "__text__").mapInArrow(outside, "__row__ long, hash long").join(corpus.rest, "hash")
    found = words.groupBy("__row__").agg(F.collect_list(F.struct("hash", "n")).alias("w")).select("__row__", *[F.col(f"w.{c}").alias(r) for c, r in zip(("hash", "n"), RARE, strict=True)])
    return numbered.join(found, "__row__", "left").drop("__row__"), numbered


def rare_words(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    """Ascending hashes and frequencies of the words in RARE of all rows; None where there is no such column."""
    if RARE[0] not in rows[0].schema.names:
        return None
    hashes, n = (np.concatenate([r.column(c).flatten().to_numpy(zero_copy_only=False) for r in rows]) for c in RARE)
    hashes, first = np.unique(hashes.view(np.uint64), return_index=True)
    return hashes, n[first]


def draw_keys(texts: pa.Array, corpus: CorpusTerms, more: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """Three words of each row that other documents hold too, as hashes (0 without any), by weighted min-wise draws."""
    keys, row, _ = document_terms(texts)
    held = corpus.frequency(keys, more)
    keys, row, held = keys[held > 1], row[held > 1], held[held > 1]
    weight = np.log1p((corpus.n - held + 0.5) / (held + 0.5)) ** 2
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(row)])
    made = []
    for k in range(3):
        out = np.zeros(len(texts), np.uint64)
        if len(row):
            u = ((textvec.mix(keys ^ textvec.PLACE[k]) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
            drawn = -np.log(u) / weight
            least = np.flatnonzero(drawn == np.repeat(np.minimum.reduceat(drawn, first), sizes))
            out[row[least]] = keys[least]
        made.append(out.view(np.int64))
    return made


class ShardIndex:
    """BM25 inverted index of a block of documents, given as term numbers and the offsets of the documents.

    With corpus, the hashes of the term numbers and the frequencies of words outside the corpus's table (more), frequencies
    and mean length are the corpus's, else the block's."""

    def __init__(
        self,
        terms: np.ndarray,
        first: np.ndarray,
        query_terms: int | None = None,
        corpus: CorpusTerms | None = None,
        hashes: np.ndarray | None = None,
        more: tuple[np.ndarray, np.ndarray] | None = None,
    ):
        n = self.n = len(first) - 1
        counts = np.diff(first)
        doc = np.repeat(np.arange(n, dtype=np.int64), counts)
        seen = np.bincount(terms) if len(terms) else np.zeros(1, np.int64)
        useful = seen[terms] > 1  # a word that occurs once in the shard finds no neighbour
        key, tf = np.unique(terms[useful].astype(np.int64) * n + doc[useful], return_counts=True)
        term, self.docs = key // max(n, 1), key % max(n, 1)
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(term)])
        total, held, mean = n, size, max(counts.mean(), 1) if n else 1
        if corpus is not None:
            found = corpus.frequency(hashes[term[start]], more)
            total, mean = corpus.n, corpus.mean
            held = np.where(found > 0, found, size)  # the others are words of one document
        idf = np.log1p((total - held + 0.5) / (held + 0.5))
        length = counts / mean
        self.weight = np.repeat(idf, size) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.docs]))
        self.start, self.size = start, size
        # A document's terms, rarest first; a query takes the rarest that other documents hold too.
        number = np.repeat(np.arange(len(start)), size)
        shared = size[number] > 1
        order = np.lexsort((held[number[shared]], self.docs[shared]))
        self.query, at = number[shared][order], np.searchsorted(self.docs[shared][order], np.arange(n + 1))
        self.query_first, self.query_end = at[:-1], at[1:] if query_terms is None else np.minimum(at[1:], at[:-1] + query_terms)
        dense = np.flatnonzero(size > DENSE * n)
        self.dense_row = np.full(len(size), -1)
        self.dense_row[dense] = np.arange(len(dense))
        # By document, so that a query is one product of a matrix and a vector of ones and zeros.
        self.dense = np.zeros((n, len(dense)), np.float32)
        at = ragged(start[dense], size[dense])
        self.dense[self.docs[at], np.repeat(np.arange(len(dense)), size[dense])] = self.weight[at]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents for the words of doc."""
        q = self.query[self.query_first[doc] : self.query_end[doc]]
        row = self.dense_row[q]
        sparse = q[row < 0]
        at = ragged(self.start[sparse], self.size[sparse])
        asked = np.zeros(self.dense.shape[1], np.float32)
        asked[row[row >= 0]] = 1
        return np.bincount(self.docs[at], self.weight[at], minlength=self.n) + self.dense @ asked

    def ranked(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a query term with doc, best first; ties by position. The leading ones are put in
        order at once, the others only if they are asked for."""
        score = self.scores(doc)
        found = np.flatnonzero((score > 0) & unused)
        value = score[found]
        cut = np.partition(value, -LEADING)[-LEADING] if len(value) > LEADING else -np.inf
        for part in (value >= cut, value < cut):
            at = np.flatnonzero(part)
            yield from found[at[np.argsort(-value[at], kind="stable")]].tolist()

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        return np.fromiter(self.ranked(doc, unused), np.int64)


def fill_windows(index: ShardIndex, lengths: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    unused, taken = np.ones(len(lengths), bool), np.zeros(len(lengths), np.int64)
    sequence, offset, oldest, seed = 0, 0, 0, -1
    queue: Iterator[int] = iter(())
    asks = -1  # whose neighbours come next; they are looked for when a document is wanted, a long seed may fill windows alone
    pieces: list[tuple[int, int, int, int, int]] = []
    while True:
        if seed < 0:  # the next neighbour, or else the oldest unused document
            if asks >= 0:
                queue, asks = index.ranked(asks, unused), -1
            seed = next((d for d in queue if unused[d]), -1)
            if seed < 0:
                while oldest < len(lengths) and not unused[oldest]:
                    oldest += 1
                if oldest == len(lengths):
                    break
                seed = oldest
            unused[seed] = False
            if offset == 0:
                asks = seed
        length = int(min(lengths[seed] - taken[seed], window - offset))
        pieces.append((seed, int(taken[seed]), length, sequence, offset))
        taken[seed] += length
        offset += length
        done = taken[seed] == lengths[seed]
        if offset == window:
            yield from pieces
            pieces, sequence, offset = [], sequence + 1, 0
            if not done:
                asks = seed
        if done:
            seed = -1
    room = 0
    for doc, start, length, _, _ in pieces:  # the last window, cut at powers of two
        while length:
            if room == 0:
                room, size = 1 << (offset.bit_length() - 1), 0
                offset -= room
            part = min(length, room)
            yield doc, start, part, sequence, size
            start, length, room, size = start + part, length - part, room - part, size + part
            sequence += room == 0


def deal(docs: DataFrame, id_col: str, text_col: str, shard_tokens: int, table_terms: int) -> tuple[DataFrame, Broadcast]:
    """The id column and __text__ of all rows (and RARE, if the table of words has no room for all that are shared), dealt
    so that a task has about a shard of rows with like keys; and the table of words."""
    texts = docs.select(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text__"))
    corpus = corpus_terms(texts.select("__text__"), table_terms)
    held = docs.sparkSession.sparkContext.broadcast(corpus)
    rest, stored = corpus.rest, []
    if rest is not None:
        texts, numbered = with_rest(texts, corpus, held)
        stored = [numbered, rest]
    keys = ["__key0__", "__key1__", "__key2__"]
    schema = T.StructType([*texts.schema, *[T.StructField(k, T.LongType(), False) for k in [*keys, "__draw__"]]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text__"):
                drawn = np.random.default_rng().integers(1 << 62, size=part.num_rows)  # written before it is used
                made = [*draw_keys(part.column("__text__"), held.value, rare_words([part])), drawn]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, made)], names=schema.names)
        release()

    keyed = materialize(texts.mapInArrow(draw, schema), "keyed-texts")
    for done in stored:
        drop_table(done)
    shards = max(1, round(1.5 * corpus.n * corpus.mean / shard_tokens))  # a little over a token a word; ranges differ
    order = [*keys, F.xxhash64(id_col), "__draw__"]
    return keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(texts.columns), held


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    shard_tokens: int = 2_000_000,
    query_terms: int | None = None,
    table_terms: int = 1 << 21,
) -> DataFrame:
    """Pieces of documents: the id column, start, ids (binary, little-endian unsigned 32-bit), length, doc_tokens,
    sequence_id and offset. query_terms bounds the length of a BM25 query (None: all words of the seed) and only orders
    neighbours. table_terms bounds the broadcast table only: words beyond it come by a join, and results are the same."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    fields = [T.StructField(n, T.LongType(), False) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields, T.StructField("ids", T.BinaryType(), False)])
    ratio = 3  # bytes of text a token, about; a shard may be larger or smaller

    def shard(rows: list[pa.RecordBatch], base: int) -> tuple[pa.RecordBatch | None, int]:
        names = pa.concat_arrays([r.column(0) for r in rows])
        encoder = worker_encoder(tokenizer_path, "word")
        ids, ends, terms, first = encoder.encode_terms(pa.concat_arrays([r.column(1) for r in rows]))
        release()  # the index and the windows need less
        hashes = np.zeros(encoder.table.size, np.uint64)
        full = encoder.table.values >= 0
        hashes[encoder.table.values[full]] = encoder.table.keys[full]
        lengths = np.diff(ends) + 1
        whole = np.insert(ids.astype("<u4"), ends[1:], end_id)
        begin = np.cumsum(lengths) - lengths
        pieces = np.array(list(fill_windows(ShardIndex(terms, first, query_terms, held.value, hashes, rare_words(rows)), lengths, window)), np.int64).reshape(-1, 5)
        doc, start, length, sequence, offset = pieces.T
        taken = whole[ragged(begin[doc] + start, length)]
        cuts = np.r_[0, np.cumsum(length)] * 4
        binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(taken)])
        made = [names.take(pa.array(doc)), *map(pa.array, (start, length, lengths[doc], sequence + base, offset)), binary]
        return pa.RecordBatch.from_arrays(made, names=schema.names), base + int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40  # sequence numbers are unique over all tasks
        rows, filled = [], 0
        for batch in batches:
            at = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ratio)
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                end = min(int(np.searchsorted(sizes, before + shard_tokens * ratio - filled)) + 1, batch.num_rows)
                rows.append(batch.slice(at, end - at))
                filled, at = filled + int(sizes[end - 1] - before), end
                if filled >= shard_tokens * ratio:
                    out, base = shard(rows, base)
                    yield out
                    rows, filled = [], 0
        if rows:
            yield shard(rows, base)[0]
        rows = []
        release()

    dealt, held = deal(docs, id_col, text_col, shard_tokens, table_terms)
    return dealt.mapInArrow(run, schema)
