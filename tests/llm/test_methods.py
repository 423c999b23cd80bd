"""The queries' whole results against plain brute force on small tables."""

import html as html_module
import itertools
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from test_jaccard import brute, shingles

from patchlane.llm import common, html_text, jaccard, language, line_crf, line_dedup, packing, quality_rules, wordbpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# op4


def test_a_group_of_near_copies_makes_few_links(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(1500):
        words = list(base)
        for _ in range(2):
            words[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    edges, pairs, candidates = [], [], []
    plain, store = jaccard.as_edges, jaccard.materialize

    def counted(links):
        edges.append(links.count())
        return plain(links)

    def watched(df, name, folder=None):
        made = store(df, name, folder)
        for kind, seen in (("pairs-", pairs), ("candidates", candidates)):
            if name.startswith(kind):
                seen.append(made.count())
        return made

    monkeypatch.setattr(jaccard, "as_edges", counted)
    monkeypatch.setattr(jaccard, "materialize", watched)
    got = {x.doc_id: x.component_id for x in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: c for i, _, c in brute(rows)}
    assert sum(edges) < 6 * len(rows)  # all links of the group would be some hundred thousand
    assert sum(pairs) < 20 * len(rows) and sum(candidates) < 20 * len(rows)


def test_groups_just_below_the_threshold_are_told_apart(spark, count=150):
    """One word replaced at one of six places, every third row with a second one: links within a place only."""
    r = random.Random(6)
    base, rows = [f"w{k}" for k in range(68)], []
    for i in range(count):
        words, place = list(base), 6 + 10 * r.randrange(6)
        words[place] = f"x{i}"
        if i % 3 == 0:
            words[place + 2] = f"y{i}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: x.component_id for x in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: c for i, _, c in brute(rows)}


def test_shingles_are_counted_over_all_slices(spark, monkeypatch):
    passage = "one and the same passage of eight words"
    rows = [(i, f"{passage} {' '.join(f'u{i}x{k}' for k in range(12))}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)  # once in each slice
    ranks = jaccard.frequent_shingles(docs, "text", 5, 1 << 20)
    h = jaccard.Sets(pa.array([passage]), 5).hash
    assert (ranks(h) == int(math.log2(40) * 6)).all()
    assert (ranks(jaccard.Sets(pa.array([rows[0][1].removeprefix(passage)]), 5).hash) == 0).all()


def test_keep_one_of_each_group(spark):
    rows = [(3, "a b c d e f g", 1), (1, "A b c d e f g", 2), (1, "A b c d e f g", 2), (7, None, 3), (7, None, 3), (8, "", 4), (None, "a b c d e f g", 5), (9, "other words are here now", 6), (None, "lone", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = sorted((tuple(x) for x in jaccard.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, "A b c d e f g", 2), (7, None, 3), (7, None, 3), (8, "", 4), (9, "other words are here now", 6), (None, "lone", 7)], key=repr)


# op5


def classes_of(text):
    kinds = {"Ll": 0, "Lo": 0, "Lm": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3}
    out = [0] * 8
    for c in text:
        k = 4 if c in "\n\r\x0b\x0c" else 3 if c == "\t" else 6 if c in "#*$%&|<>@\\_/" else None
        if k is None:
            cat = unicodedata.category(c)
            k = kinds.get(cat, 5 if cat[0] == "P" else 6 if cat[0] == "S" else 7) if ord(c) < 0x10000 else 7
        out[k] += 1
    return out


def js(p, q):
    if not sum(p):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / max(sum(q), 1) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    return math.sqrt(max((kl(p) + kl(q)) / 2, 0))


def test_quality_rules_whole_result(spark):
    r = random.Random(1)
    lexicon = {"de": "der die und Haus ΛΟΓΟΣ İSTANBUL Straße nicht".split(), "en": "the of House and tree in that".split()}
    rows = [(i, " ".join(r.choice(lexicon[v]) for _ in range(r.randint(60, 200))) + ("." if i % 2 else "\n"), v) for i in range(24) for v in lexicon]
    rows += [(100, "§§ $$ %% " * 90, "de"), (101, " ".join("the zz" for _ in range(80)), "en"), (102, None, "en"), (103, "", None), (104, rows[0][1], None), (105, rows[1][1], "xx"), (None, rows[2][1], "en"), (106, "few words", "en"), (100, "§§ $$ %% " * 90, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality_rules.judge(docs, quality_rules.references(docs, min_reference_words=500), carry=["doc_id", "text", "lang"]).collect()
    reference = {}
    for v in lexicon:
        texts = [t or "" for _, t, x in rows if x == v]
        lower = [pa.compute.utf8_lower(pa.array([t]))[0].as_py() for t in texts]
        words = Counter(w for t in lower for w in WORD.findall(t))
        common_ = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:64]
        reference[v] = [sum(c) for c in zip(*map(classes_of, texts))], [w for w, _ in common_], [n for _, n in common_] + [sum(words.values()) - sum(n for _, n in common_)]
    assert len(got) == len(rows)
    for x in got:
        text = x.text or ""
        low = WORD.findall(pa.compute.utf8_lower(pa.array([text]))[0].as_py())
        n = len(WORD.findall(text))
        mine = [x.lang] if x.lang in reference else list(reference)
        chars = min(js(classes_of(text), reference[v][0]) for v in mine)
        common_ = min(js([low.count(w) for w in reference[v][1]] + [sum(w not in reference[v][1] for w in low)], reference[v][2]) for v in mine)
        assert (x.char_distance, x.word_distance) == (pytest.approx(chars, abs=1e-9), pytest.approx(common_, abs=1e-9))
        assert x.kept == (not x.base_failed and (len(text) < 200 or chars <= 0.27) and (n < 100 or common_ <= 0.4))
    assert {x.doc_id for x in got if not x.kept} >= {100, 102, 103, 106}


# op6


@pytest.mark.parametrize("hot", [True, False])
def test_a_line_of_a_third_of_all_rows(spark, hot):
    line = "a line that very many documents of many sites hold"
    rows = [(i, f"{line if i % 3 == 0 else f'own first line number {i}'}\nown text number {i} is here", f"s{i % 10}") for i in range(600)]
    rows += [(1000 + i, f"the rarer line is on five sites\nand its text is number {i}", f"s{i}") for i in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8" if hot else "1")  # a quarter of a partition: 38 or 303 lines
    try:
        made = {r.doc_id: r.n_removed for r in line_dedup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made == {i: int(i % 3 == 0 and i > 0 or i > 1000) for i, _, _ in rows}


def test_line_dedup_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "t", "s", 5, 6, "x")], "doc_id long, text string, source string, n_lines long, h1 int, site string")
    assert line_dedup.remove_spread_lines(docs, carry=docs.columns, prefix="__").select("doc_id", "n_lines", "h1", "site", "text").first() == (1, 5, 6, "x", "t")


# op7


def test_repeated_words_are_cut_by_their_number(spark):
    rows = [(i, "same " * 20_000) for i in range(60)] + [(99, "solo")]
    batch = pa.RecordBatch.from_pydict({"words": [20_000] * 60 + [1]})
    parts = list(common.slices(batch, batch.column("words").to_numpy(), wordbpe.SLICE_WORDS))
    assert sum(p.num_rows for p in parts) == 61 and max(p.num_rows for p in parts) <= 21
    made = wordbpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    assert Counter(r.n_tokens for r in made)[20_000] == 60


# op1


def test_sample_is_bounded_in_rows_and_lines(spark):
    rows = [(1, f"repeated identifier {i}") for i in range(5000)] + [(2, "line\n" * 3000), (3, "good")] + [(4, "copy")] * 50
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1), (4, 0)], "doc_id long, quality int")
    taken = line_crf.sample(docs, labels, "doc_id", "text", "quality", 10, 1000).collect()
    assert Counter(r.id for r in taken) == {1: 4, 4: 1, 3: 1} or Counter(r.id for r in taken) == {1: 5, 3: 1}
    lines = line_crf.sample(docs, labels, "doc_id", "text", "quality", 4000, 1000).collect()
    assert sum(r.text.count("\n") + 1 for r in lines if r.label == 0) <= 500


def test_quality_scores_equal_enumerated_chains(spark):
    r = random.Random(2)
    clean, junk = ["Many plain words stand in this line.", "A second line follows it here."], ["BUY!! NOW!! *** $$$", "xx | yy | zz | ||| %%%"]
    rows = [(i, "\n".join(r.choice((clean, junk)[i % 2]) for _ in range(r.randint(1, 6)))) for i in range(60)] + [(70, None), (71, " \n"), (72, "\n".join([clean[0], junk[0], "", clean[1]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = line_crf.train(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(0, 1)], "doc_id long, quality int"))
    a, b = model.calibration
    for x in line_crf.score(docs, model, carry=["doc_id", "text"]).collect():
        lines = [line for line in (x.text or "").split("\n") if line.strip(" \t\r\x0b\x0c")]
        if not lines:
            assert (x.score, x.predicted) == (0, 0)
            continue
        features, _, _ = line_crf.line_features(pa.array([x.text]))
        emission = ((features - model.mean) / model.scale) @ model.weights
        total, good = 0.0, np.zeros(len(lines))
        for y in itertools.product((0, 1), repeat=len(lines)):
            p = math.exp(sum(e for e, v in zip(emission, y) if v) + sum(model.transition[u, v] for u, v in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        # Characters as the classes count them: a line and the feed that ends it.
        at, ends = 0, []
        for line in x.text.split("\n"):
            at += len(line) + 1
            ends.append((line, at))
        size = np.array([len(line) + (end <= len(x.text)) for line, end in ends if line.strip(" \t\r\x0b\x0c")])
        mean = float(np.clip((good / total * size).sum() / size.sum(), 1e-3, 1 - 1e-3))
        assert x.score == pytest.approx(1 / (1 + math.exp(-(a * math.log(mean / (1 - mean)) + b))), abs=1e-6)
        assert x.predicted == (x.score >= 0.5)


# op2


PROSE = "This is the text of a page that has no telling names at all, and it is to be found by the words that are in it. "
LINKS = "".join(f"<a href='/{i}'>This is in the place {i}</a> " for i in range(12))
BARE = f"<div><div>{LINKS}</div><div>Top</div></div><div><div>Title here</div><div>{PROSE * 2}</div><div>Short one.</div><div>{PROSE}</div></div><div><div>{'Zqx vrt plk ' * 12}</div><div>End</div><div>{LINKS}</div></div>"


def test_density_and_neighbours_decide_where_no_name_tells(monkeypatch):
    """Neither articles nor names: blocks are good by their words, and short ones by their neighbours."""
    good = html_text.main_text(BARE)
    assert good == " ".join(["Title here", (PROSE * 2).strip(), "Short one.", PROSE.strip()])
    monkeypatch.setattr(html_text, "STOP", set())
    assert html_text.main_text(BARE) != good
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "MAX_LINKS", 2.0)
    assert html_text.main_text(BARE) != good
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "SHORT", 0)
    assert html_text.main_text(BARE) != good


def test_link_lists_in_articles_are_bad():
    page = f"<article><p>{PROSE}</p><ul><li>{LINKS}</li></ul><p>{PROSE}</p></article>"
    assert html_text.main_text(page) == " ".join([PROSE.strip(), PROSE.strip()])


def test_broken_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<div>" * 20_000 + "</span>" * 20_000, "<a " * 60_000, '<a "' * 60_000, "<!--" * 60_000, "<![CDATA[" * 30_000, "<p>x" * 60_000, "<script>" * 60_000, "</div>" * 60_000, "<li>" * 60_000, "<" * 200_000, "&" * 200_000):
        html_text.main_text(page)
    assert time.perf_counter() - began < 8


def test_entities_are_those_of_the_standard():
    assert html_text.main_text("<article><p>" + PROSE + "&eacute;&#233;&lt;b&gt;</p></article>").endswith(html_module.unescape("&eacute;&#233;&lt;b&gt;"))


# op9


def bm25(words, query, df, n, mean):
    tf, score = Counter(words), 0.0
    for w in sorted(set(query)):
        if tf[w]:
            score += math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / mean))
    return score


def test_windows_equal_a_greedy_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(r.randint(3, 60))) for _ in range(80)]
    words = [t.split() for t in texts]
    df, mean = Counter(w for x in words for w in set(x)), sum(map(len, words)) / len(words)
    made = packing.corpus_terms(spark.createDataFrame([(t,) for t in texts], "__text__ string").repartition(3), 1 << 16)
    number = {w: i for i, w in enumerate(sorted(df))}
    keys = np.array([packing.document_terms(pa.array([w]))[0][0] for w in sorted(df)])
    first = np.r_[0, np.cumsum([len(x) for x in words])]
    index = packing.ShardIndex(np.array([number[w] for x in words for w in x]), first, None, made, keys)
    unused = np.array([r.random() < 0.8 for _ in texts])
    for d in range(0, 80, 7):
        scores = {k: bm25(words[k], words[d], df, 80, mean) for k in range(80) if unused[k] and set(words[k]) & set(words[d])}
        got = index.neighbours(d, unused).tolist()
        assert set(got) == set(scores)
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(got, got[1:]))
    # Greedy filling: the seed, then its unused neighbours in that order, then the first unused document.
    lengths, window = np.array([len(x) for x in words]), 64
    pieces = list(packing.fill_windows(index, lengths, window))
    left, sequence, filled, queue, seed = set(range(80)), 0, 0, [], None
    expected, taken = [], Counter()
    while left or seed is not None:
        if seed is None:
            seed = next((d for d in queue if d in left), None)
            seed = min(left) if seed is None else seed
            left.remove(seed)
            if filled == 0:
                queue = index.neighbours(seed, np.array([d in left for d in range(80)])).tolist()
        n = min(int(lengths[seed]) - taken[seed], window - filled)
        expected.append((seed, taken[seed], n, sequence, filled))
        taken[seed] += n
        filled += n
        own, seed = seed, None if taken[seed] == lengths[seed] else seed
        if filled == window:
            filled, sequence = 0, sequence + 1
            if seed is not None:
                queue = index.neighbours(own, np.array([d in left for d in range(80)])).tolist()
    whole = [e for e in expected if e[3] < sequence]
    assert pieces[: len(whole)] == whole


# op10


def grams_of(text):
    raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in pa.compute.utf8_lower(pa.array([text]))[0].as_py().encode())
    padded = b" " + raw + b" "
    return [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != 32]


def fit(counts, p, names, rounds=12):
    share = {v: 1 / len(names) for v in names} if not isinstance(names, dict) else {v: x / sum(names.values()) for v, x in names.items()}
    for _ in range(rounds):
        new = dict.fromkeys(share, 0.0)
        for g, n in counts.items():
            total = sum(share[v] * p[v][g] for v in share)
            for v in share:
                new[v] += n * share[v] * p[v][g] / total
        share = {v: x / sum(counts.values()) for v, x in new.items()}
    return share, sum(n * math.log(sum(share[v] * p[v][g] for v in share)) for g, n in counts.items())


def test_language_mixture_whole_result(spark):
    r = random.Random(3)
    lexicon = {"en": "the of and this house tree river".split(), "de": "der und nicht wald haus fluß über".split(), "fr": "le et une dans maison rivière été".split()}
    text = lambda v, n: " ".join(r.choice(lexicon[v]) for _ in range(n))
    train = [(i, text(v, 60), v) for i in range(12) for v in lexicon] + [(99, "ignored", None)]
    asked = [text(v, n) for v in lexicon for n in (1, 3, 12)] + [text("en", 20) + " " + text("de", 20), text("en", 25) + " " + text("fr", 25) + "\n" + text("de", 25), None, "", "12 !", "漢字", text("de", 30)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(3))
    counts = {v: Counter(g for _, t, x in train if x == v for g in grams_of(t)) for v in lexicon}
    every = set().union(*counts.values())
    p = {v: {g: (counts[v][g] + 0.5) / (sum(counts[v].values()) + 0.5 * (len(every) + 1)) for g in every} for v in lexicon}
    got = {x.doc_id: x for x in language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    biggest = max(sorted(lexicon), key=lambda v: sum(counts[v].values()))
    for i, t in enumerate(asked):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        known = Counter(g for g in grams_of(t) if g in every)
        if not known:
            assert got[i].lang_pred == biggest
            continue
        single = {v: sum(n * math.log(p[v][g]) for g, n in known.items()) for v in lexicon}
        own, price = {max(sorted(lexicon), key=lambda v: single[v]): 1.0}, -2 * max(single.values())
        full, _ = fit(known, p, sorted(lexicon))
        ranked = sorted(sorted(lexicon), key=lambda v: -full[v])
        for m in range(2, 4):
            share, ll = fit(known, p, {v: max(full[v], 1e-6) for v in ranked[:m]})
            now = -2 * ll + (m - 1) * math.log(max(sum(known.values()), 2))
            if now >= price:
                break
            own, price = share, now
        best = max(sorted(own), key=lambda v: own[v])
        assert got[i].lang_pred == best and got[i].score == pytest.approx(own[best], abs=1e-3)


def test_every_trigram_of_a_small_language_stays(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(676)), "big") for i in range(60)] + [(1000, "ĉu ŝi ĝojas", "small")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.grams) == len({g for _, t, _ in rows for g in grams_of(t)})
    assert language.identify(spark.createDataFrame([(1, "ŝi ĝojas")], "doc_id long, text string"), model).first().lang_pred == "small"


def test_sets_of_the_brute_force_are_the_module_s():
    assert len(shingles("a b c d e f")) == jaccard.Sets(pa.array(["a b c d e f"]), 5).size[0] == 2
