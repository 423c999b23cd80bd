import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patchlane.llm.chunkcodec import ChunkEncoder

CASES = [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")]
MADE = {c: (ChunkEncoder(P.path(c[0]), c[1]), Tokenizer.from_file(P.path(c[0]))) for c in CASES}
letters = st.sampled_from(list("abcE's!#é́   \n\t\r\x0b\x1c\x01ß3Σ<|") + ["  ", " \n", "<|endoftext|>", "don't", "　", "가"])


@pytest.mark.parametrize("case", CASES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(letters, max_size=20).map("".join), max_size=5))
def test_same_ids_as_the_library(case, texts):
    own, library = MADE[case]
    ids, offsets = own.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("case", CASES)
def test_nulls_empty_and_a_full_table(case):
    own = ChunkEncoder(P.path(case[0]), case[1], max_chunks=3)
    for texts in ([None, "", "one two three four"], ["one two", " "], []):
        ids, offsets = own.encode(pa.array(texts, pa.string()))
        assert len(offsets) == len(texts) + 1 and offsets[-1] == len(ids)
        for i, t in enumerate(texts):
            assert np.array_equal(ids[offsets[i] : offsets[i + 1]], MADE[case][1].encode(t or "", add_special_tokens=False).ids)
