"""Edge cases and brute-force checks of the training-data operators on small tables."""

import re
import zipfile
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from patchlane.llm import common, files, html_text, language, line_crf, line_dedup, media, packing, quality_rules, sstable
from patchlane.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 700}" for i in range(9000))
TEXTS = [None, "", " \n\t", "one", "The same line of text here.\nThe same line of text here.\nother", LONG, "a b c d e a b c d e f", "straße Ünï\nx", "The same line of text here.\nThe same line of text here.\nother"]
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, start string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 2 else None, t, ["en", None, "de"][i % 3], f"s{i}", "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], (3, "another of one id", None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_quality_rules_base_counts_and_guards(docs, empty):
    made = quality_rules.judge(docs, quality_rules.references(docs), carry=["doc_id", "text", "score"]).collect()
    assert len(made) == docs.count()
    for r in made:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty, quality_rules.references(empty)).collect() == []


def test_js_distance():
    p = np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [2.0, 2.0]])
    assert quality_rules.distance(p, np.array([5.0, 0.0])) == pytest.approx([0, 1, 0, np.sqrt(0.5 * (0.5 * np.log2(0.5 / 0.75) + 0.5 * np.log2(0.5 / 0.25)) + 0.5 * np.log2(1 / 0.75))])


def test_line_dedup_keeps_the_first_of_spread_lines(spark, empty):
    line, short = "this line stands on many sites", "tiny"
    rows = [(i, f"{line}\nown text of document {i}\n{short}", None, f"site{i % 7}" if i else None, None, None, None) for i in range(14)]
    rows += [(20 + i, f"few sites only have this\n{line} {i}", None, f"site{i % 2}", None, None, None) for i in range(10)] + [(50, None, None, "s", None, None, None), (51, "", None, "s", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    short_too = {r.doc_id: r for r in line_dedup.remove_spread_lines(frame, min_sites=5).collect()}
    assert short_too[0].text == rows[0][1] and all(short_too[i].text == f"own text of document {i}" and short_too[i].n_removed == 2 for i in range(1, 14))
    made = {r.doc_id: r for r in line_dedup.remove_spread_lines(frame, min_sites=5, short_chars=19, short_sites=8).collect()}
    assert made[0].text == rows[0][1] and made[0].n_removed == 0
    assert all(made[i].text == f"own text of document {i}\n{short}" and made[i].n_removed == 1 for i in range(1, 14))
    assert all(made[20 + i].n_removed == 0 for i in range(10))
    assert made[50].text is None and made[51].text == "" and made[51].n_lines == 1
    assert line_dedup.remove_spread_lines(empty).collect() == []


def test_near_threshold_lines_are_counted_exactly(spark):
    # The sketch is so coarse that the margin it needs takes in every line.
    rows = [(i, f"line of {n} sites in all, long enough", None, f"site{i % n}", None, None, None) for n in (99, 100, 101) for i in range(300 * n, 301 * n)]
    made = line_dedup.remove_spread_lines(spark.createDataFrame(rows, SCHEMA), min_sites=100, lg_k=4).collect()
    assert {len(r.text) > 0 and int(r.text.split()[2]) for r in made if r.text} == {99, 100, 101}
    assert sum(r.n_removed for r in made) == 99 + 100


def packed(docs, **options):
    path = P.path("word_bpe_49k.json")
    return packing.pack(docs, path, **options).collect(), Tokenizer.from_file(path)


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 3000, "window": 256}])
def test_packing_covers_every_token_once(docs, empty, options):
    rows, own = packed(docs, **options)
    window = options.get("window", 2048)
    expected = Counter()
    for r in docs.collect():
        expected[(r.doc_id, tuple(own.encode(r.text or "", add_special_tokens=False).ids + [1]))] += 1
    pieces: dict = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = Counter()
    for (i, n), parts in pieces.items():
        same = [k for k in expected if k[0] == i and len(k[1]) == n]
        assert sum(len(p) for _, p in parts) == n * sum(expected[k] for k in same)
        for k in same:
            assert all(any(list(k[1][s : s + len(p)]) == p for k in same) for s, p in parts)
            got[k] += expected[k]
    assert got == expected
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    assert packed(empty, **options)[0] == []


def test_bm25_returns_the_document_that_shares_rare_words():
    terms = np.array([1, 2, 3, 9, 1, 2, 4, 5, 6, 7, 9, 3])
    index = packing.ShardIndex(terms, np.array([0, 4, 7, 10, 12]), 24)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist()[:2] in ([3, 1], [1, 3])
    assert index.neighbours(2, np.ones(4, bool)).tolist() == []


def test_near_copies_from_any_file_share_a_shard(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4000, 60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"{t} more{i}") for i, t in enumerate(texts)]  # copies 300 rows on
    scattered = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")
    made = packing.pack(scattered, P.path("word_bpe_49k.json"), window=512, shard_tokens=12_000).selectExpr("doc_id", "sequence_id >> 40 as task").distinct().collect()
    tasks = {r.doc_id: r.task for r in made}
    assert len(tasks) == 600 and len(set(tasks.values())) > 3
    assert sum(tasks[i] == tasks[1000 + i] for i in range(300)) > 240


def test_document_frequencies_are_those_of_the_whole_table(spark):
    texts = ["a b b", "a c", None, "b a", "d"]
    made = packing.corpus_terms(spark.createDataFrame([(t or "",) for t in texts], "__text__ string").repartition(4), 100)
    keys, _, _ = packing.document_terms(pa.array(["a b c d"]))
    assert made.frequency(keys).tolist() == [3, 2, 0, 0] and (made.n, made.mean) == (5, 8 / 5)
    index = packing.ShardIndex(np.array([0, 1, 0, 1]), np.array([0, 2, 4]), None, made, keys[:2])
    assert np.allclose(np.unique(index.weight), np.unique([np.log1p((5 - f + 0.5) / (f + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.6)) for f in (3, 2)]))


def test_sstable_round_trip_and_lookup(spark, docs, empty):
    path, folder = P.path("byte_bpe_50k.json"), common.shared_dir(spark)
    own = Tokenizer.from_file(path)
    manifest = sstable.write_tables(docs, path, folder, block_bytes=300)
    rows = sstable.read_tables(manifest, blocks_a_read=2).orderBy("start").collect()
    assert len(rows) == docs.count()
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    expected = Counter((r.doc_id, tuple([*own.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == expected
    shards = [sstable.Shard(r.path) for r in manifest.collect()]
    for (i, tokens), n in expected.items():
        found = [tuple(x.tolist()) for s in shards for x in s.lookup(i)]
        assert found.count(tokens) == n
    assert [x for s in shards for x in s.lookup(12345)] == []
    assert sstable.store_and_read(spark, empty, path).collect() == []


def check_digest(text):
    """n_bytes, payload_bytes, payload_sha256 and tail_crc32 straight from a text."""
    raw = (text or "").encode()
    payload = raw.ljust(max(-(-len(raw) // 192), 1) * 192)
    return len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_media_round_trip_ranges_and_retries(spark, docs, empty, monkeypatch):
    folder = common.shared_dir(spark)
    media.write_archives(docs, folder, archive_bytes=2000)
    decoded = media.digests(media.decode_media(media.read_archives(spark, folder, range_bytes=700))).collect()
    expected = Counter((r.doc_id, *check_digest(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in decoded) == expected
    by_text: dict = {}
    for r in decoded:
        by_text.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.store_and_read(spark, empty).collect() == []
    system, path = files.resolve(folder)
    with system.open_output_stream(f"{path}/part-000000-00000-lost.zip") as out:  # what an attempt that was lost left behind
        out.write(b"no archive")
    assert media.read_archives(spark, folder).count() == docs.count()

    reader = media.MediaArchiveReader({"path": folder})
    part = next(p for p in reader.partitions() if p.path)
    with zipfile.ZipFile(files.reading(part.path)) as z:
        info = z.infolist()[0]
    good, _ = reader.member(part.path, info, files.reading(part.path))

    class Broken:
        def seek(self, _):
            raise OSError("gone")

    assert reader.member(part.path, info, Broken())[0] == good
    monkeypatch.setattr(media, "reading", lambda _: Broken())
    with pytest.raises(OSError, match="member at"):
        reader.member(part.path, info, Broken())


def test_png_is_lossless():
    for n in (0, 1, 191, 192, 193, 5000):
        text = bytes(i * 7 % 256 for i in range(n))
        samples, size = media.decode_png(media.encode_png(text))
        assert size == n and samples.tobytes()[:n] == text and samples.size % 192 == 0
    data = bytearray(media.encode_png(b"x"))
    data[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(data))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="home">
<header><a href=/>no</a></header><div class="cookie-notice">We use the cookies that are in all of the pages of this site to give you the best.</div>
<nav><ul><li><a href="a">no one</a><li><a href="b">no two</a></ul></nav><main><article><header><h1>A title &amp; more</h1></header>
<p>This is the first   paragraph of the article, and it is long enough to be good by itself.<br>It goes&nbsp;on.</p><p>Short.
<p>The <b>sec</b>ond <!-- <p>no</p> --> one is of the same kind, with a <a href="x">link</a> in it for the reader.</p>
<aside>no aside</aside><div class="ad"><p>no advert that is in the middle of the text for all of us</p></div><p>End</p></article>
<section id="comments"><p>no reader comment that is as long as the paragraphs of the article are, and it is here.</p></section></main>
<form><label>no</label><input value="no"></form><footer>no &copy; footer</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == (
        "A title & more This is the first paragraph of the article, and it is long enough to be good by itself. It goes on. Short. "
        "The second one is of the same kind, with a link in it for the reader. End"
    )
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    for cut in range(0, len(PAGE), 37):
        html_text.main_text(PAGE[:cut])
    plain = "<div><p>" + "This is the text of a page that has no article at all, and it is found. " * 3 + "</p><p>ok</p></div><div id=nav>no</div>"
    assert html_text.main_text(plain).endswith("found. ok")
    many = "<article>" + "<p>x" * 20_000
    assert len(html_text.main_text(many).split()) == 20_000


def test_html_on_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, len(rows[0].text or rows[1].text), len(rows[0].text or rows[1].text)]
    assert html_text.extract(pages.where("false")).collect() == []


WORDS = {"en": "the of and this that with house tree river", "de": "der und die nicht ein wald haus fluss stein", "fr": "le et une dans pour maison arbre riviere"}


def test_language_mixture(spark, empty):
    r = np.random.default_rng(0)
    text = lambda v, n: " ".join(r.choice(WORDS[v].split(), n))
    train = spark.createDataFrame([(i, text(v, 80), v, None, None, None, None) for i in range(20) for v in WORDS], SCHEMA)
    model = language.train(train)
    asked = [(1, text("de", 12), None), (2, text("en", 40) + " " + text("fr", 25), None), (3, None, None), (4, "123 !? \n", None), (5, "漢字", None), (6, "", None)]
    rows = {x.doc_id: x for x in language.identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), model).collect()}
    assert rows[1].lang_pred == "de" and rows[1].score == 1
    assert rows[2].lang_pred == "en" and 0.5 < rows[2].score < 0.8
    assert [rows[i].lang_pred for i in (3, 4, 6)] == ["und"] * 3 and rows[5].lang_pred in WORDS
    assert language.identify(empty, model).collect() == []
    none = language.train(empty)
    assert language.identify(train.limit(1), none).first().lang_pred == "und"


def chain_brute(emission, transition):
    n = len(emission)
    total, good = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        p = np.exp(sum(e * v for e, v in zip(emission, y)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total, np.log(total)


def test_crf_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    first, transition = np.array([0, 3, 3, 8, 9]), r.normal(size=(2, 2))
    emission = r.normal(size=9)
    good, counts, log_z = line_crf.chain(emission, first, transition, pairs=True)
    parts = [chain_brute(emission[a:b], transition) for a, b in zip(first, first[1:]) if b > a]
    assert np.allclose(good, np.concatenate([p for p, _ in parts])) and log_z == pytest.approx(sum(z for _, z in parts))
    assert counts.sum() == pytest.approx(2 + 4)


def test_quality_classifier(spark, docs, empty):
    clean = "Many plain words stand in this line of text.\nAnd a second line follows it, as it should."
    junk = "BUY!! NOW!! *** $$$\nxx | yy | zz | ||| %%%\n" * 2
    rows = [(i, (clean, junk)[i % 2], None, None, None, None, None) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = line_crf.train(table, labels)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in line_crf.score(table, model).collect())
    scores = line_crf.score(docs, model, carry=["doc_id", "text"]).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert all(r.score == 0 for r in scores if not (r.text or "").strip())
    assert line_crf.score(empty, model).collect() == [] and line_crf.train(table, labels.where("false")) is None


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (0, 5, 100, 3, 0)]})
    assert pa.Table.from_batches(list(common.text_slices(batch, "t", 4))).to_pydict() == batch.to_pydict()
