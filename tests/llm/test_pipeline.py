"""The corpus pipeline's stages and its whole run against brute force on small tables."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from test_jaccard import brute
from tokenizers import Tokenizer

import corpus_pipeline
from patchlane.llm import line_crf, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, n_words string"
CLEAN = "the of and house tree in that with river stone under over light green about".split()


def made(seed=1, count=60):
    r = random.Random(seed)
    spread = "subscribe to our letter and read it every day of the week"
    rows = []
    for i in range(count):
        text = "\n".join(" ".join([*(r.choice(CLEAN) for _ in range(9)), f"u{i}x{k}"]) for k in range(6))
        if i % 4 == 0:
            text += "\n" + spread
        if i % 10 == 9:
            text = rows[-2][1].replace(f"u{i - 2}x0", f"v{i}")  # a near copy
        if i % 7 == 3:
            text = "*** $$$ BUY NOW ||| %%% ### @@@ !!!\n" * 5
        rows.append((i, text, "en", f"s{i % 9}", len(text), 0.5, "x"))
    extra = [(None, rows[1][1] + "\nand one more line that no other text has", None, None, None, None, None), (100, None, "en", "s1", None, None, "y"), (101, "", None, "s2", 0, None, None), (102, "few words", "xx", None, 9, None, None)]
    return [*rows, *extra, rows[2], (5, rows[6][1] + " another text of one id", "en", "s3", 1, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(made(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 3), 0) for i in range(40)] + [(3, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def as_rows(df):
    return Counter(tuple(x) for x in df.collect())


def test_filters_keep_whole_rows(spark, folder):
    docs = docs_of(spark, folder)
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    scored = line_crf.score(docs, line_crf.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), carry=docs.columns, names=("__s", "__p"))
    assert kept.columns == docs.columns and as_rows(kept) == Counter(tuple(x)[:7] for x in scored.collect() if x["__s"] >= 0.5)
    assert {x.doc_id for x in kept.collect()} >= {i for i in range(60) if i % 7 != 3 and i % 10 != 9} and not {x.doc_id for x in kept.collect()} & {100, 101, *range(3, 60, 7)}
    kept = corpus_pipeline.quality_rules_stage(spark, docs, folder)
    judged = quality_rules.judge(docs, quality_rules.references(docs), carry=docs.columns, prefix="__")
    assert kept.columns == docs.columns and as_rows(kept) == Counter(tuple(x)[:7] for x in judged.collect() if x["__kept"])
    assert not {x.doc_id for x in kept.collect()} & {100, 101, 102}


def without_spread_lines(rows):
    """Lines on five sites or more stay once, at the least identifier (null first) and place."""
    sites, first = {}, {}
    for i, text, _, source, *_ in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\v\f\r"):
                sites.setdefault(line, set()).add(source)
                at = (i is not None, i or 0, text, k)
                first[line] = min(first.get(line, at), at)
    spread = {line for line, s in sites.items() if len(s - {None}) >= 5}
    out = []
    for i, text, lang, source, n, *rest in rows:
        if text is not None:
            lines = text.split("\n")
            text = "\n".join(line for k, line in enumerate(lines) if line not in spread or (i is not None, i or 0, text, k) == first[line])
        out.append((i, text, lang, source, None if text is None else len(text), *rest))
    return out


def one_of_each(rows):
    """Which identifiers of rows with words are kept: the least of each class."""
    classes = {}
    for i, n, c in brute([(r[0], r[1]) for r in rows]):
        if n:
            classes.setdefault(c, set()).add(i)
    return {min(x, key=lambda i: (i is None, i or 0)) for x in classes.values()}


def test_line_dedup_and_near_duplicates_equal_brute_force(spark, folder):
    docs = docs_of(spark, folder)
    plain = [tuple(x) for x in docs.collect()]
    assert as_rows(corpus_pipeline.line_dedup_stage(spark, docs, folder)) == Counter(without_spread_lines(plain))
    kept = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert set(kept) <= set(plain) and [x for x in kept if not (x[1] or "").split()] == [x for x in plain if not (x[1] or "").split()]
    worded = [x for x in kept if (x[1] or "").split()]
    assert {x[0] for x in worded} == one_of_each(plain)
    components = {i: c for i, n, c in brute([(x[0], x[1]) for x in worded]) if n}
    assert all(i == c for i, c in components.items() if i is not None)  # no two of those kept are linked


def test_whole_run(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "line_dedup", "near_duplicates", "retrieval_packing"]
    docs = docs_of(spark, folder)
    good = [tuple(x) for x in corpus_pipeline.quality_rules_stage(spark, corpus_pipeline.quality_classifier(spark, docs, folder), folder).collect()]
    clean = without_spread_lines(good)
    wanted = one_of_each(clean)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id for x in pieces} == wanted | {x[0] for x in clean if not (x[1] or "").split()}
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sizes = {}
    for i, text, *_ in clean:
        sizes.setdefault(i, set()).add(len(own.encode(text or "", add_special_tokens=False).ids) + 1)
    covered = {}
    for x in pieces:
        covered.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, x.length))  # two texts of one id differ in length
    for (i, n), parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n and n in sizes[i]
    by = {}
    for x in pieces:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)


def test_empty_tables(spark, folder):
    docs = docs_of(spark, folder)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).collect() == []
