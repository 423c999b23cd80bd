import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from patchlane.llm import textvec

TEXTS = st.lists(st.text(st.sampled_from("ab \n\tÄ　z"), max_size=30), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_lines_as_regular_expressions_find_them(texts):
    raw, offsets = textvec.utf8(pa.array(texts, pa.string()))
    spans = textvec.words(raw, offsets)
    h = textvec.hashes(raw, spans.start, spans.end)
    found = [raw[a:b].tobytes().decode() for a, b in zip(spans.start, spans.end, strict=True)]
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert found == sum(expected, [])
    assert spans.counts().tolist() == [len(x) for x in expected]
    assert len(set(h.tolist())) == len(set(found))
    start, end, doc = textvec.lines(raw, offsets)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == sum((t.split("\n") for t in texts), [])
    assert doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split("\n")]


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    word = "straße-" * 9
    text = ("x " * 1000 + word + " ") * 700
    raw, offsets = textvec.utf8(pa.array([text]))
    spans = textvec.words(raw, offsets)
    h = textvec.hashes(raw, spans.start, spans.end)
    assert len(raw) > 2 * textvec.BLOCK and len(np.unique(h)) == 2
    long = ("y" * 3 * textvec.BLOCK).encode()
    raw = np.frombuffer(long + b" " + long, np.uint8)
    spans = textvec.words(raw, np.array([0, len(raw)]))
    assert len(np.unique(textvec.hashes(raw, spans.start, spans.end))) == 1
