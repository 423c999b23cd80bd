"""Quality rules: base counts of a text, and the divergence of its histograms from its language's.

References are made from all documents: for each language the pooled histogram of character classes, and that of its
`common` most frequent words (and one bin for all others). A document fails where the Jensen-Shannon distance (base 2, 0
to 1) of its character classes is above max_char_distance, or that of its common words above max_word_distance. Histograms
of short texts say little, so a text of fewer than min_chars characters passes the first test and one of fewer than
min_words words passes the second. A document without a language, or with one whose reference holds fewer than
min_reference_words words, is compared with every other reference and takes the smallest distance.

Base counts: words are runs other than 0x20 and 0x09-0x0D. n_repeat_words counts the words that lie in a 5-word window
found twice or more in the text. base_failed: fewer than 10 words, or over a fifth of the words repeated.

Defined cases: a null or empty text has zero counts and fails; a null language is as said; equal rows get equal results;
an empty table gives no rows; further columns only pass where the caller names them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .chunkcodec import ragged
from .common import release, text_slices

CLASSES = ("lower", "upper", "digit", "space", "break", "mark", "symbol", "other")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
_class_of: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Character class of every code point below 0x10000; made once a worker."""
    if not _class_of:
        kinds = {"Ll": 0, "Lo": 0, "Lm": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3}
        made = np.full(0x10000, 7, np.uint8)
        for i in range(0x10000):
            c = unicodedata.category(chr(i))
            made[i] = kinds.get(c, 5 if c[0] == "P" else 6 if c[0] == "S" else 7)
        made[[ord(c) for c in "\n\r\x0b\x0c"]] = 4
        made[ord("\t")] = 3
        made[[ord(c) for c in "#*$%&|<>@\\_/"]] = 6
        _class_of.append(made)
    return _class_of[0]


def class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    kinds = np.where(points < 0x10000, class_table()[np.minimum(points, 0xFFFF)], 7)
    firsts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    return np.bincount(row * len(CLASSES) + kinds, minlength=(len(offsets) - 1) * len(CLASSES)).reshape(-1, len(CLASSES))


def _inside(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def base_counts(raw: np.ndarray, offsets: np.ndarray, spans: textvec.Spans, word: np.ndarray) -> list[np.ndarray]:
    """The columns of BASE."""
    solid = ~textvec.WS[raw]
    start, end, doc = textvec.lines(raw, offsets)
    filled = np.r_[0, np.cumsum(solid, dtype=np.int64)]
    full = filled[end] > filled[start]
    key = textvec.mix(textvec.hashes(raw, start[full], end[full]) + doc[full].astype(np.uint64) * textvec.PLACE[9])
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(doc[full][order][again], minlength=len(offsets) - 1)

    h, at = textvec.windows(word, spans, WINDOW)
    row = np.searchsorted(spans.first, at, "right") - 1
    key = textvec.mix(h + row.astype(np.uint64) * textvec.PLACE[9])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.bincount(at[twice], minlength=len(word) + WINDOW) - np.bincount(at[twice] + WINDOW, minlength=len(word) + WINDOW)
    repeated = np.cumsum(cover)[: len(word)] > 0
    return [spans.counts(), _inside(solid & ((raw & 0xC0) != 0x80), offsets), _inside(SYMBOLS[raw], offsets), dup_lines, _inside(repeated, spans.first)]


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, textvec.Spans, np.ndarray]:
    """Bytes, offsets, words and word hashes of the texts in lower case; references and documents both take their words here."""
    raw, offsets = textvec.utf8(pc.utf8_lower(texts))
    spans = textvec.words(raw, offsets)
    return raw, offsets, spans, textvec.hashes(raw, spans.start, spans.end)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of counts p from the histogram q; 0 for rows without counts."""
    total = p.sum(1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0)), 0)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = 64, min_reference_words: int = 1000) -> dict[str, tuple]:
    """For each language: histogram of character classes, hashes of its common words and their histogram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                made = class_counts(*textvec.utf8(part.column("text")))
                langs = part.column("lang").dictionary_encode()
                number = langs.indices.to_numpy(zero_copy_only=False)
                sums = np.stack([np.bincount(number, c, minlength=len(langs.dictionary)) for c in made.T]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs.dictionary, *map(pa.array, sums)], names=["lang", *CLASSES])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                langs = part.column("lang").dictionary_encode()
                raw, offsets, spans, word = folded_words(part.column("text"))
                lang = langs.indices.to_numpy(zero_copy_only=False)[spans.doc()]
                key = textvec.mix(word + lang.astype(np.uint64) * textvec.PLACE[11])
                _, first, n = np.unique(key, return_index=True, return_counts=True)  # one of each word and language, with its count
                size = spans.end[first] - spans.start[first]
                cuts = np.r_[0, np.cumsum(size)].astype(np.int32)
                own = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(raw[ragged(spans.start[first], size)])])
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[first])), own, pa.array(n)], names=["lang", "word", "n"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    classes = known.mapInArrow(count, "lang string, " + ", ".join(f"{c} long" for c in CLASSES)).groupBy("lang").agg(*[F.sum(c).alias(c) for c in CLASSES])
    words = known.mapInArrow(words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The first words of each language; Spark keeps at most `common` a task before the shuffle.
    ranked = words.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference_words)
    top = ranked.where(F.col("k") <= common).groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("words")).join(totals, "lang")
    made = {}
    for r in classes.join(top, "lang").collect():  # a row for each language that has a reference
        raw, offsets = textvec.utf8(pa.array([w["word"] for w in r["words"]], pa.string()))
        counts = np.array([w["n"] for w in r["words"]], float)
        made[r["lang"]] = (np.array([r[c] for c in CLASSES], float), textvec.hashes(raw, offsets[:-1], offsets[1:]), np.r_[counts, r["total"] - counts.sum()])
    return made


def judge(
    docs: DataFrame,
    known: dict[str, tuple],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: list[str] | None = None,
    max_char_distance: float = 0.27,
    max_word_distance: float = 0.4,
    min_chars: int = 200,
    min_words: int = 100,
    prefix: str = "",
) -> DataFrame:
    """The columns in carry (the id column), the base counts, base_failed, char_distance, word_distance and kept, the
    names of these after the prefix."""
    carry = [id_col] if carry is None else carry
    names = [prefix + n for n in (*BASE, "base_failed", "char_distance", "word_distance", "kept")]
    kinds = [T.LongType()] * len(BASE) + [T.BooleanType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    carry = [c for c in carry if c not in names]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(known)  # a few hundred numbers a language

    def verdict(part: pa.RecordBatch) -> list:
        known = shared.value
        raw, offsets = textvec.utf8(part.column("__text__"))
        spans = textvec.words(raw, offsets)
        base = base_counts(raw, offsets, spans, textvec.hashes(raw, spans.start, spans.end))
        n = base[0]
        failed = (n < 10) | (100 * base[4] > 20 * n)
        classes = class_counts(raw, offsets)
        _, _, low_spans, word = folded_words(part.column("__text__"))
        row = low_spans.doc()
        langs = part.column("__lang__").to_pylist()
        chars, common = np.full(len(n), np.inf), np.full(len(n), np.inf)
        unknown = np.array([v not in known for v in langs], bool)
        for lang in known if unknown.any() else {v for v in langs if v in known}:
            class_reference, hashes, word_reference = known[lang]
            mine = np.array([v == lang for v in langs], bool) | unknown
            order = np.argsort(hashes)
            at = np.minimum(np.searchsorted(hashes[order], word), len(hashes) - 1)
            bin_ = np.where(hashes[order][at] == word, order[at], len(hashes))
            counts = np.bincount(row * (len(hashes) + 1) + bin_, minlength=len(n) * (len(hashes) + 1)).reshape(len(n), -1)
            chars = np.where(mine, np.minimum(chars, distance(classes, class_reference)), chars)
            common = np.where(mine, np.minimum(common, distance(counts, word_reference)), common)
        chars, common = (np.where(np.isinf(x), 0.0, x) for x in (chars, common))
        kept = ~failed & ((classes.sum(1) < min_chars) | (chars <= max_char_distance)) & ((n < min_words) | (common <= max_word_distance))
        return [*(b.astype(np.int64) for b in base), failed, chars, common, kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text__"):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carry))), *map(pa.array, verdict(part))], names=schema.names)
        release()

    text, lang = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text__"), docs[lang_col].cast("string").alias("__lang__")
    return docs.select(*[docs[c] for c in carry], text, lang).mapInArrow(run, schema)
