"""Host reputation, spelling variants and conversation repair: whole results against brute force, and their defined cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from patchlane.llm import dialogue, host_reputation, queries, spelling

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, views):
    """The query of op SQL over the given tables equals its SQL."""
    con = duckdb.connect()
    for t in views:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    made = [tuple(r) for r in df.select(cols).collect()]
    cursor = con.execute(queries.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in cols]
    said = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    trim = lambda rows: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert len(made) == len(said) > 0 and trim(made) == trim(said)


@pytest.mark.parametrize("name,views", [("op11_host_reputation", ("pages", "labels")), ("op12_pivotal_spelling", ("documents",)), ("op13_persistent_audit", ("conversations",))])
def test_queries_equal_their_sql(spark, name, views):
    same_as_sql(spark, name, views)


# Host reputation

PAGES = "page_id long, url string, host string, n int"
LABELS = "doc_id long, quality int, toxic int"


def posterior_bounds(hosts, z):
    """Upper bounds of the hosts' good shares; hosts: name -> (domain, suffix, n, good)."""

    def fit(children, parent):
        over = sum((g - n * parent[c]) ** 2 - n * parent[c] * (1 - parent[c]) for c, (n, g) in children.items())
        under = sum(n * (n - 1) * parent[c] * (1 - parent[c]) for c, (n, g) in children.items())
        r = min(max(over / under, 1e-4), 1 / 3) if under else 1 / 3
        return (1 - r) / r

    def added(index):
        out = {}
        for name, row in hosts.items():
            n, g = out.get(row[index], (0, 0))
            out[row[index]] = n + row[2], g + row[3]
        return out

    suffixes, domains, own = added(1), added(0), {h: row[2:] for h, row in hosts.items()}
    n, g = (sum(v[i] for v in suffixes.values()) for i in (0, 1))
    above = dict.fromkeys(suffixes, (g + 1, n + 2, n))
    for level, up in ((suffixes, {row[0]: row[1] for row in hosts.values()}), (domains, {h: row[0] for h, row in hosts.items()}), (own, None)):
        parent = {c: (above[c][0] - g) / (above[c][1] - n) for c, (n, g) in level.items()}
        s = fit(level, parent)
        worth = {c: min(s, above[c][2] - n + 2) for c, (n, g) in level.items()}
        beta = {c: (worth[c] * parent[c] + g, worth[c] + n, n) for c, (n, g) in level.items()}
        above = up and {c: beta[p] for c, p in up.items()}
    return {h: a / t + z * (a * (t - a) / (t**2 * (t + 1))) ** 0.5 for h, (a, t, _) in beta.items()}


def test_bad_hosts_are_blocked_and_bounds_equal_the_formulas(spark):
    rng = random.Random(3)
    kinds = {"spam.bad.net": 0.05, "more.bad.net": 0.1, "good.fine.org": 0.9, "a.fine.org": 0.95, "lone.fine.org": None, "www.shop.co.uk": 0.8, "x.shop.co.uk": 0.7, "10.0.0.1:80": 0.5}
    pages, labels, counts = [], [], {h: [0, 0] for h in kinds}
    number = 0
    for host, share in kinds.items():
        for k in range(400 if host == "good.fine.org" else 60):  # a hot host
            pages.append((number, f"http://{host.upper()}/p/{k}?q=1", None, None))
            if share is not None and k % 2:
                good = rng.random() < share
                labels.append((number, int(good), 0) if k % 4 == 1 else (number, 1, int(not good)))
                counts[host][0] += 1
                counts[host][1] += good
            number += 1
    domains = {"spam.bad.net": ("bad.net", "net"), "more.bad.net": ("bad.net", "net"), "www.shop.co.uk": ("shop.co.uk", "co.uk"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "10.0.0.1:80": ("10.0.0.1", "")}
    hosts = {h: (*domains.get(h, ("fine.org", "org")), *counts[h]) for h in kinds}
    made = host_reputation.judge(spark.createDataFrame(pages, PAGES).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert len(made) == len(pages)
    bound = posterior_bounds(hosts, host_reputation.Z)
    for r in made:
        assert (r.n_labelled, r.n_good) == tuple(counts[r.host]) and r.rule is None
        assert r.good_bound == pytest.approx(bound[r.host], rel=1e-9)
        assert r.verdict == ("block" if bound[r.host] < 0.5 else "allow")
    assert {r.host for r in made if r.verdict == "block"} == {"spam.bad.net", "more.bad.net"}


def test_rules_and_defined_cases_of_urls(spark):
    urls = ["http://Example.ORG/es/1", "http://a.example.org/es/", "http://badexample.org/es/", "http://example.org/en/1x", "http://example.org/en/2", "http://example.org", "https://x.com/fr/?a", "http://x.com/de/#b", "http://x.com?/de/", "no scheme", None, "", "://", "http:///de/", "ftp://u@h.com:21/de/a://b", "http://x.com/de\n/", "http://x..org/q"]
    rows = [(i if i % 5 else None, u, "clash", 1) for i, u in enumerate(urls)] * 2
    made = host_reputation.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame([(0, None, 1), (None, 0, 0), (1, 1, None), (1, 0, None)], LABELS), host_reputation.RULES).collect()
    assert len(made) == len(rows)

    def expected(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0] or [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in host_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in made) == Counter((i, *expected(u)) for i, u, *_ in rows)
    empty = spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)
    assert host_reputation.judge(*empty).collect() == []
    assert {r.verdict for r in host_reputation.judge(spark.createDataFrame(rows, PAGES), empty[1]).collect()} == {"allow"}


def test_main_path_is_native(spark):
    pages, labels = spark.createDataFrame([(1, "http://a.b/c", "", 1)], PAGES), spark.createDataFrame([(1, 1, 0)], LABELS)
    plan = host_reputation.judge(pages, labels, host_reputation.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Spelling

def brute_variants(counts, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    order = sorted(words)
    near = {w: [] for w in order}
    for a, b in itertools.combinations(order, 2):
        if abs(len(a) - len(b)) <= 1:
            i = 0
            while i < min(len(a), len(b)) and a[i] == b[i]:
                i += 1
            rest = (a[i + 1 :], b[i + 1 :]) if len(a) == len(b) else (a[i + 1 :], b[i:]) if len(a) > len(b) else (a[i:], b[i + 1 :])
            if rest[0] == rest[1]:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in order:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = set()
    for w in order:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    letters = "abéz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaab", "ababab", "bababa", "abababa"]
    counts = Counter()
    for w in base:
        counts[w] += rng.choice([5, 30, 200, 1000])
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            counts[rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] += rng.choice([1, 5, 6, 40])
    words = spark.createDataFrame([(w, n) for w, n in counts.items() if len(w) >= 6 and n >= 5], "word string, n long").repartition(3)
    made = {tuple(r) for r in spelling.variants(words).collect()}
    assert made == brute_variants(counts)
    assert any(form != root for _, form, root, *_ in made if form)  # a chain of forms


def test_prefix_and_pivots_hold_the_filter():
    """For every pair that one edit parts: one of the pivots of the word whose prefix ends first stands in the other's prefix."""
    rng = np.random.default_rng(1)
    ranks = rng.permutation(spelling.CLASSES)
    for _ in range(300):
        a = rng.integers(97, 100, rng.integers(4, 10)).astype(np.uint32)
        i = rng.integers(len(a))
        b = [np.delete(a, i), np.insert(a, i, 98), np.concatenate([a[:i], [99], a[i + 1 :]]).astype(np.uint32)][rng.integers(3)]
        if len(b) < 4 or np.array_equal(a, b):
            continue
        (pa_, va, la), (pb, vb, lb) = (spelling.prefix_and_pivots(w, ranks) for w in (a, b))
        first, second, pivots, prefix = (a, b, va, pb) if la <= lb else (b, a, vb, pa_)
        assert pivots[1] - pivots[0] >= 2
        assert any(np.array_equal(first[p : p + 2], second[q : q + 2]) and abs(p - q) <= 1 for p in pivots for q in prefix)
        gram = ranks[spelling.gram_class(first[:-1], first[1:])]
        own = spelling.prefix_and_pivots(first, ranks)[0]
        assert gram[pivots].sum() == min(gram[p] + gram[q] for p in own for q in own if q - p >= 2)


def test_runs_and_damage_equal_python(spark):
    texts = [None, "", "ÀÉ×÷ÿ ŒUVRE Straße straße", "word " * 500 + "wordy-wordier_wordiest", "l’été naïveté 東京 naïveté", "x"]
    rows = [(i if i != 3 else None, t, "w") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    expected = Counter()
    for i, t, _ in rows:
        run = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\u00c0" <= c <= "\u00ff":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                expected[run if h % 7 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    made = Counter(r.word for r in spelling.drop_some(spelling.runs(docs), every=7).collect())
    assert made == expected
    assert spelling.variants(spelling.vocabulary(spelling.drop_some(spelling.runs(docs.limit(0))))).collect() == []
    with pytest.raises(ValueError):
        spelling.vocabulary(docs, min_chars=3)


# Conversations

def brute_audit(turns):
    """Cheapest (cost, audit, repaired lines) over all edit sequences; turns: (role, text, fault)."""
    best = {(0, 0): (0, "", ())}
    for i in range(len(turns) + 1):
        for _ in range(3):  # insertions, as many as help
            for state in range(4):
                if (i, state) in best:
                    c, a, out = best[i, state]
                    to, role = (3, "assistant") if state == 2 else (2, "user")
                    new = (c + 5, a + "I", (*out, f"{role}:"))
                    best[i, to] = min(best.get((i, to), new), new)
        if i == len(turns):
            break
        role, text, fault = turns[i]
        for state in range(4):
            if (i, state) not in best:
                continue
            c, a, out = best[i, state]
            options = [(state, c + 2, a + "D", out)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                to, own = (3, "assistant") if state == 2 else (2, "user")
                options.append((to, c + 1 + extra, a + "R", (*out, f"{own}:{text}")))
                lead = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if lead and state in {1: (0,), 2: (0, 1, 3), 3: (2,)}[lead]:
                    options.append((lead, c + extra, a + "K", (*out, f"{role}:{text}")))
            for to, *new in options:
                new = tuple(new)
                best[i + 1, to] = min(best.get((i + 1, to), new), new)
    return min(best[len(turns), s] for s in (0, 3) if (len(turns), s) in best)


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        tail = text.rstrip(" \t\n\v\f\r")[-1:]
        out.append((role, text, "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else ""))
        seen.add((role, text))
    return out


def test_audits_equal_brute_force(spark):
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "tool", None, "", "uncle"], ["One.", "Two!", "cut off", " ", "", None, "Three? ", "One.\n\t"]
    rows = []
    for conv in range(250):
        for t in range(rng.randint(1, 9)):
            rows.append((conv if conv else None, rng.choice([t, t, t, 2, None, t + 5]), rng.choice(roles[: rng.choice([3, 7])]), rng.choice(texts[: rng.choice([2, 8])]) if rng.random() < 0.5 else f"Text {rng.random()}.", "x"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(5)
    damaged = dialogue.damage(frame)
    made = {r.conv_id: r for r in dialogue.audit(damaged, dropped="dropped").collect()}
    fixed = {}
    for r in dialogue.repair(damaged, dropped="dropped").collect():
        fixed.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.edit))
    assert set(made) == {r[0] for r in rows}
    for conv in made:
        kept = []
        for _, turn, role, text, _ in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
                kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = faults_of([r[1:] for r in kept])
        cost, audit, lines = brute_audit(turns)
        numbers = [r[0] for r in kept if r[0] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(turns)]
        r = made[conv]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert [r.blank, r.duplicate, r.truncated] == [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        mine = sorted(fixed.get(conv, []))
        assert [m[0] for m in mine] == list(range(len(lines))) and [f"{m[1]}:{m[2]}" for m in mine] == list(lines)
        assert "".join(m[3] for m in mine) == audit.replace("D", "")
    assert dialogue.audit(frame.limit(0)).collect() == []


def test_long_conversations_settle_and_spool(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "SETTLE", 16)
    monkeypatch.setattr(dialogue, "SPOOL_BYTES", 1000)
    rng = random.Random(2)
    for kind in range(6):
        turns = [(rng.choice([["user", "assistant"], ["tool"], ["user"], ["system", "assistant"], ["user", "assistant", "tool"], ["user"]][kind]), f"{i} {'x' * 40}" + rng.choice([".", "", "."])) for i in range(150)]
        held = dialogue.Conversation()
        for i, (role, text, fault) in enumerate(faults_of(turns)):
            held.add(i, role, text, fault)
        cost, audit, lines = brute_audit(faults_of(turns))
        assert held.audits.finish() == (cost, audit)
        assert [f"{r}:{t}" for _, r, t in held.repaired(audit)] == list(lines)


def chain(text):
    node = dialogue.Edit(None)
    for c in text:
        node = dialogue.Edit(node, c)
    return node


@pytest.mark.parametrize("modulus", [dialogue.MODULUS, 3])
def test_comparison_of_audits_survives_collisions(monkeypatch, modulus):
    monkeypatch.setattr(dialogue, "MODULUS", modulus)
    rng = random.Random(4)
    for _ in range(400):
        root = chain("".join(rng.choice("DIKR") for _ in range(rng.randrange(20))))
        ends = []
        for _ in range(2):
            node = root
            for c in "".join(rng.choice("DK") for _ in range(rng.randrange(12))):
                node = dialogue.Edit(node, c)
            ends.append(node)
        a, b = ends
        x, y = dialogue.letters(a), dialogue.letters(b)
        assert dialogue.earlier(a, b) == (x < y)
        assert dialogue.letters(dialogue.shared_node(a, b)) == dialogue.letters(root) or x[: len(dialogue.letters(root)) + 1] == y[: len(dialogue.letters(root)) + 1]
        for depth in range(a.depth + 1):
            assert dialogue.letters(dialogue.ancestor(a, depth)) == x[:depth]
