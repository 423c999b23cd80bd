import random
import re

import pytest

from patchlane.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(s), least.get(root(x)) if s else i) for x, (i, s) in enumerate(sets)), key=repr)


def made(seed, count=160):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice(["", "x", "Ö", "yz"])
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(count):
        kind = r.random()
        if rows and kind < 0.55:
            words = (r.choice(rows)[1] or "a b").split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.65:
            text = passage + " " + " ".join(word() for _ in range(r.randint(1, 25)))
        else:
            text = r.choice([" ", "\n\t"]).join(word() for _ in range(r.randint(1, 60)))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 4)  # small tables have salted shingles then
    rows = [*made(seed), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (None, "one two"), (None, "lone words"), (905, "q " * 3000), (5, "one two")]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert jaccard.link_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tested_pairs_are_looked_up_by_one_join(spark, monkeypatch):
    """Not by one for each table of them, each of which gives all the candidates again."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 4)
    joins, store = {}, jaccard.materialize

    def stored(df, name, folder=None):
        joins[name] = df._jdf.queryExecution().analyzed().toString().count("Join LeftAnti")
        return store(df, name, folder)

    monkeypatch.setattr(jaccard, "materialize", stored)
    rows = made(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert "pairs-1" in joins and joins["candidates"] == 1 and all(n <= 1 for name, n in joins.items() if name.startswith(("pairs", "rest")))
