"""Spelling variants of a corpus's words: pivotal grams find all pairs of words that one edit parts.

1. Words are counted; those of enough characters and occurrences make the vocabulary, one row for each.
2. Bigrams are ranked by how many words hold them, rare first. A word's prefix is its three rarest bigrams (all that tie
   with the third), its pivots are the two of them that do not overlap and are rarest together, found by dynamic
   programming over places. One edit spoils one pivot at most, and if a's rarest three end no later in the ranking than
   b's, a pivot of a that the edit leaves alone stands in b's prefix.
3. Pivots meet prefixes at the place that one edit allows: the edit lies wholly before or wholly behind the pivot, so the
   other side of the word, pivot included, is the same in both. The key of the join is that side and the length of the
   word it is looked for in; it fixes the gram and its place, so what meets is nearly alike already.
4. Each pair that meets is verified once, by the edit distance of its words.
5. A word's form is its much more frequent near word; roots follow forms to the last, by doubling the steps.

A word of L characters over an alphabet of A has less than (2 L + 1) A near words, so no join by word has a hot key. Words
are counted with partial sums before the shuffle. The ranking is over 65,536 classes of bigrams, whatever the alphabet, so
its table has a bound; it orders candidates only, results do not depend on it.

Defined cases: a null text has no words; a null identifier is an empty text where it names a row; equal rows count each; an
empty table gives no rows; further columns are not read. Words of fewer than four characters have no two pivots, so less is
refused. Order of words is by code points everywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, shared_dir

CLASSES = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, letters: str = "A-Za-zÀ-ÿ", id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """id (text) and run of every maximal run of letters of at least min_chars; A-Z are lower-cased, nothing else is."""
    text = F.translate(docs[text_col].cast("string"), UPPER, LOWER)
    found = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, f"[^{letters}]+")).alias("run"))
    return found.where(F.char_length("run") >= max(min_chars, 1))


def drop_some(found: DataFrame, every: int = 199) -> DataFrame:
    """The runs as words, where each (id, run) whose checksum `every` divides lost a character: misspellings made by rule."""
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return found.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """word and n of the words of enough characters and occurrences."""
    if min_chars < 4:
        raise ValueError("two pivots need words of four characters or more")
    counted = words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def gram_class(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The class of a bigram of two code points; over alphabets of up to 256 neighbouring characters, its own."""
    return (a.astype(np.int64) * 256 + b) % CLASSES


def code_points(words: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words.to_pylist()]


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each class of bigrams: classes of few words first, ties by number. At most 65,536 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for w in code_points(batch.column("word")):
                total[np.unique(gram_class(w[:-1], w[1:]))] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["gram", "n"])

    counts = np.zeros(CLASSES, np.int64)
    for r in words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return ranks


def prefix_and_pivots(word: np.ndarray, ranks: np.ndarray) -> tuple[list[int], list[int], int]:
    """Places of the prefix's bigrams and of the two pivots, and the prefix's last rank.

    A class's rank orders bigrams; unequal ones of one class tie, and all ties of the third enter the prefix."""
    rank = ranks[gram_class(word[:-1], word[1:])]
    last = int(np.partition(rank, 2)[2])
    places = np.flatnonzero(rank <= last).tolist()
    # one[i] is the rarest bigram among the first i places; the best pair ends at i with one[number of places before i - 1].
    one: list[int] = [places[0]]
    best, pair = None, (0, 0)
    for i in range(1, len(places)):
        p = places[i]
        before = i if p - places[i - 1] >= 2 else i - 1
        if before:
            q = one[before - 1]
            weight = int(rank[p] + rank[q])
            if best is None or weight < best:
                best, pair = weight, (q, p)
        one.append(p if rank[p] < rank[one[-1]] else one[-1])
    return places, list(pair), last


def keyed(words: DataFrame, ranks: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The index of pivots and the prefixes: rows of word, n, last (rank) and the key: side, part, size.

    part is the word as far as the gram's end (side 0) or from its start (side 1), size the length of the word that holds
    the prefix: for a pivot each length that one edit allows."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def made(pivots: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, last_, side, part, size = [], [], [], [], []
                for i, (text, word) in enumerate(zip(batch.column("word").to_pylist(), code_points(batch.column("word")), strict=True)):
                    prefix, pair, last = prefix_and_pivots(word, shared.value)
                    for p in pair if pivots else prefix:
                        for length in range(len(text) - 1, len(text) + 2) if pivots else (len(text),):
                            at += i, i
                            last_ += last, last
                            side += 0, 1
                            part += text[: p + 2], text[p:]
                            size += length, length
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(index), batch.column("n").take(index), pa.array(last_, pa.int32()), pa.array(side, pa.int32()), pa.array(part, pa.string()), pa.array(size, pa.int32())],
                    names=["word", "n", "last", "side", "part", "size"],
                )

        return words.select("word", "n").mapInArrow(run, "word string, n long, last int, side int, part string, size int")

    return made(True), made(False)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b (a's prefix ends no later in the ranking) of every two words that one edit parts, each pair once.

    words: word, n; a table that is read three times."""
    pivots, prefixes = (t.select(F.xxhash64("side", "part", "size").alias("key"), *map(F.col, ("word", "n", "last"))) for t in keyed(words, gram_ranks(words)))
    a, b = (t.select("key", F.col("word").alias(w), F.col("n").alias(f"n_{w}"), F.col("last").alias(f"last_{w}")) for t, w in ((pivots, "a"), (prefixes, "b")))
    met = a.join(b, "key").where("a != b and (last_a < last_b or (last_a = last_b and a < b))")
    met = met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return met.where(F.levenshtein("a", "b", 1) == 1)


def forms(words: DataFrame, pairs: DataFrame, times: int = 5) -> DataFrame:
    """words with form (the near word of largest n, ties by code points, if its n is at least `times` the word's; else null),
    n_near and form_n."""
    each = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    best = pairs.select(each.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    much: Column = -F.col("best.less") >= times * F.col("n")
    joined = words.join(best, "word", "left")
    return joined.select("word", F.when(much, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame, folder: str, times: int = 5) -> DataFrame:
    """formed with root: the last of the word's form, its form's form and so on.

    Counts grow `times` as large with each form, so the steps are no more than their logarithm; each round doubles them."""
    least, most = formed.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(most / least, times)) + 1 if most else 0
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(max(steps - 1, 0).bit_length()):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, links = links, materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}", folder)
        if k:
            drop_table(before)
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (word, n)."""
    folder = shared_dir(words.sparkSession)
    words = materialize(words, "words", folder)
    formed = materialize(forms(words, near_pairs(words), times), "forms", folder)
    return roots(formed, folder, times).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 of a list of bytes, as DuckDB can compute it: b is the list.
CRC32 = """xor(list_reduce({b}, lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)]), 4294967295::bigint), 4294967295::bigint)"""
CRC_TABLE = """
rounds(i, k, v) as (
  select i, 0, i::bigint from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from rounds where k < 8
), crc as (select list(v order by i) as crc_table from rounds where k = 8)"""

#: What op12 gives on documents: near words by shared deletions.
SQL = f"""
with recursive {CRC_TABLE},
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents
), counted as (select id, run, count(*) as n from runs where length(run) >= 6 group by all
), hashed as (
  select id, run, n, {CRC32.format(b="flatten(list_transform(string_split(id || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)] else [195, ord(x) - 64] end))::bigint[]")} as h
  from counted, crc
), cut as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
), words as (select word, sum(n)::bigint as n from cut where length(word) >= 6 group by word having sum(n) >= 5
), less as (
  select word, n, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as other, b.n as m from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select l.word, w.word, w.n from less l join words w on l.rest = w.word
  union select w.word, l.word, l.n from less l join words w on l.rest = w.word
), best as (select word, count(*) as n_near, min({{'less': -m, 'other': other}}) as best from near group by word
), formed as (
  select w.word, case when -best.less >= 5 * n then best.other end as form, n, coalesce(n_near, 0) as n_near, case when -best.less >= 5 * n then -best.less end as form_n
  from words w left join best b on w.word = b.word
), steps as (
  select word, word as root, 0 as k from formed
  union all select s.word, f.form, k + 1 from steps s join formed f on s.root = f.word where f.form is not null
), last as (select word, arg_max(root, k) as root from steps group by word)
select word, form, root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from formed join last using (word)
"""
