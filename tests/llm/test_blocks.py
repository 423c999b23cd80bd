"""op9 and pipeline: words of a slice are looked for in blocks, and a batch of words encodes each pre-token once."""

import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from patchlane.llm import packing
from patchlane.llm.chunkcodec import ChunkEncoder, Chunks
from patchlane.llm.common import BLOCK_BYTES

PATH = P.path("word_bpe_49k.json")


def test_terms_of_many_blocks_are_held_in_little_memory():
    texts = [" ".join(f"w{(k * 7 + j) % 900} shared" for j in range(k % 400)) for k in range(1500)] + ["long " * 60000, None, ""]
    batch = pa.array(texts, pa.string())
    tracemalloc.start()
    keys, row, words = packing.document_terms(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(len(t or "") for t in texts)
    assert size > 8 * BLOCK_BYTES and peak < 8 * size + 40 * BLOCK_BYTES
    one = {w: int(packing.document_terms(pa.array([w]))[0][0]) for w in {w for t in texts for w in (t or "").split()}}
    found = [set() for _ in texts]
    for k, r in zip(keys.tolist(), row.tolist()):
        assert k not in found[r]
        found[r].add(k)
    assert found == [{one[w] for w in (t or "").split()} for t in texts] and (np.diff(row) >= 0).all()
    assert words == sum(len((t or "").split()) for t in texts)


def test_frequencies_of_any_table():
    r = np.random.default_rng(3)
    for size in (0, 1, 2, 3, 1000, 4096):
        keys = np.unique(np.r_[r.integers(0, 1 << 63, size, np.uint64) * np.uint64(2), np.array([0, 2**64 - 1], np.uint64)[:size]])
        r.shuffle(keys)
        docs = r.integers(1, 1 << 40, len(keys))
        corpus = packing.CorpusTerms(keys, docs, 10, 5.0)
        other = np.setdiff1d(r.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2) + np.uint64(1), keys)
        assert corpus.frequency(keys).tolist() == docs.tolist() and not corpus.frequency(other).any()


def test_each_pre_token_is_encoded_once():
    encoder, given = ChunkEncoder(PATH, "word"), []
    encode = encoder.encode_tokens
    encoder.encode_tokens = lambda tokens: given.extend(tokens.strings()) or encode(tokens)
    words = [f"{w}{s}" for w in ("année", "YEAR", "year", "Straße", "À") for s in ("", ",", ".", "12", "1,1", "!?")]
    ids, lengths = encoder.encode_plain(Chunks.of(words))
    assert len(given) == len(set(given)) and {"année", "year", "straße", "à", ",", "!?", "1"} <= set(given)
    cuts = np.r_[0, np.cumsum(lengths)]
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
