"""Language identification by multilingual mixture inference.

A model holds, for each language, smoothed likelihoods of letter trigrams (of UTF-8 bytes in lower case, any run of other
characters being one word border), counted over all documents that the caller passes for training. A document is a mixture
of languages: expectation-maximisation estimates the proportions from its trigrams' likelihoods. The language set is the
one whose penalised likelihood (Bayesian information criterion, one parameter for each further language) is best among the
best single language and the leading 2, 3, ... languages of the mixture, as long as one more betters the likelihood; the
prediction is its largest share.

The model keeps every trigram of the training texts. A trigram is three of 155 signs (letters, bytes above 127, border),
so there are at most 3.7 million of them, whatever the corpus: at most 15 MB a language, and as a rule below 1 MB.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is everything where there is no training
row; a text with letters but no known trigram gets the language with the most training trigrams and its share as score;
equal rows get equal results; an empty table gives no rows; further columns pass only where the caller names them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .chunkcodec import ragged
from .common import compute_columns, text_slices

NONE = "und"


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the identifier as text has remainder 1 by 3; a null is no such row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def letters_only(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in lower case, ASCII other than letters as spaces."""
    raw, offsets = textvec.utf8(pc.utf8_lower(texts))
    letter = np.ones(256, bool)
    letter[:128] = False
    letter[97:123] = True
    return np.where(letter[raw], raw, np.uint8(32)), offsets


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (24 bits) and rows of all trigrams; each text has a border before and behind it."""
    raw, offsets = letters_only(texts)
    n = len(offsets) - 1
    place = np.arange(len(raw)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    padded = np.full(len(raw) + 2 * n, 32, np.uint32)
    padded[place] = raw
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)
    if len(padded) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    keep = (b != 32) & (row[:-2] == row[2:])  # a letter in the middle, and one document
    return (a << 16 | b << 8 | c)[keep], row[:-2][keep]


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes, ascending
    log_p: np.ndarray  # trigram by language; the last row is for unknown ones
    share: np.ndarray  # of all training trigrams, by language


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """A model of all rows of docs whose language is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                code, row = trigrams(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                key = langs.indices.to_numpy(zero_copy_only=False).astype(np.uint64)[row] << np.uint64(24) | code
                key, n = np.unique(key, return_counts=True)
                lang = langs.dictionary.take(pa.array((key >> np.uint64(24)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([lang, pa.array((key & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Rows are bounded by the alphabet; they come in Arrow columns, not as objects.
    held = counts.toArrow()
    names, grams, n = held.column("lang").combine_chunks().dictionary_encode(), held.column("gram").to_numpy(), held.column("n").to_numpy()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    languages = sorted(names.dictionary.to_pylist())
    place = np.array([languages.index(v) for v in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy(zero_copy_only=False)] if held.num_rows else np.zeros(0, np.int64)
    codes, at = np.unique(grams, return_inverse=True)
    c = np.zeros((len(codes) + 1, len(languages)), np.float32)  # the last row: trigrams that no training text holds
    c[at, place] = n
    total = np.bincount(place, n, minlength=len(languages))
    p = (c + smoothing) / (total + smoothing * (len(codes) + 1))
    return Model(languages, codes.astype(np.uint32), np.log(p).astype(np.float32), total / max(total.sum(), 1))


def mixture(p: np.ndarray, count: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (row by language) and log-likelihood of each row by EM; row d has the grams first[d] .. first[d + 1]."""
    size = np.diff(first)
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(count, first[:-1])
    for _ in range(rounds):
        w = p * np.repeat(share, size, axis=0)
        w *= (count / w.sum(1))[:, None]
        share = np.add.reduceat(w, first[:-1], axis=0) / total[:, None]
    fit = np.add.reduceat(count * np.log((p * np.repeat(share, size, axis=0)).sum(1)), first[:-1])
    return share, fit


def infer(texts: pa.Array, model: Model, rounds: int = 12) -> list:
    """Predicted language and its score for each text."""
    n, k = len(texts), len(model.languages)
    best, score = np.full(n, -1), np.zeros(n)
    has_letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
    if k and n:
        best[has_letter], score[has_letter] = int(model.share.argmax()), model.share.max()
        code, row = trigrams(texts)
        at = np.minimum(np.searchsorted(model.grams, code), max(len(model.grams) - 1, 0))
        known = model.grams[at] == code if len(model.grams) else np.zeros(len(code), bool)
        key, count = np.unique(row[known] << 24 | at[known], return_counts=True)
        row, at = key >> 24, key & 0xFFFFFF
        rows, first = np.unique(row, return_index=True)
        if len(rows):
            first, count = np.r_[first, len(row)], count.astype(float)
            log_p = model.log_p[at].astype(float)
            p = np.exp(log_p - log_p.max(1, keepdims=True))  # only ratios matter
            total = np.add.reduceat(count, first[:-1])
            single = np.add.reduceat(log_p * count[:, None] - (log_p.max(1) * count)[:, None], first[:-1], axis=0)
            own = np.zeros((len(rows), k))
            own[np.arange(len(rows)), single.argmax(1)] = 1
            cost = -2 * single.max(1)
            full, _ = mixture(p, count, first, np.ones((len(rows), k)), rounds)
            order = np.argsort(-full, axis=1, kind="stable")
            left = np.arange(len(rows))  # rows whose last language bettered the price
            for m in range(2, k + 1):
                size = np.diff(first)[left]
                at_, first_ = ragged(first[:-1][left], size), np.r_[0, np.cumsum(size)]
                allowed, leading = np.zeros((len(left), k)), order[left, :m]
                np.put_along_axis(allowed, leading, np.maximum(np.take_along_axis(full[left], leading, 1), 1e-6), 1)
                share, fit = mixture(p[at_], count[at_], first_, allowed, rounds)
                price = -2 * fit + (m - 1) * np.log(np.maximum(total[left], 2))
                better = price < cost[left]
                left = left[better]
                if not len(left):
                    break
                own[left], cost[left] = share[better], price[better]
            best[rows], score[rows] = own.argmax(1), np.clip(own.max(1), 0, 1)
            best[~has_letter], score[~has_letter] = -1, 0
    names = np.array([*model.languages, NONE], object)
    return [pa.array(names[best].tolist(), pa.string()), pa.array(score)]


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (doc_id), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    return compute_columns(docs, text_col, ["doc_id"] if carry is None else carry, fields, lambda texts: infer(texts, shared.value), limit=2 << 20)
