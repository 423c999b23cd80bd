"""op9: words beyond the broadcast table count like those in it."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from patchlane.llm import packing
from patchlane.llm.chunkcodec import ChunkEncoder

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("table_terms", [0, 40])
def test_a_small_table_gives_the_same_pieces(spark, table_terms):
    r = random.Random(4)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 3000}" for _ in range(r.randint(0, 50))) for _ in range(150)]
    rows = spark.createDataFrame([*enumerate([*texts, *texts[:20], None])], "doc_id long, text string").repartition(3)
    made = [sorted(map(tuple, packing.pack(rows, PATH, window=256, table_terms=t).collect())) for t in (table_terms, 1 << 16)]
    assert len(made[0]) > 150 and made[0] == made[1]


def test_frequencies_beyond_the_table(spark):
    texts = ["a b c d", "a b c", "a b e", "a e", "a f"]
    held = Counter(w for t in texts for w in set(t.split()))
    docs = spark.createDataFrame([(t,) for t in texts], "__text__ string").repartition(2)
    corpus = packing.corpus_terms(docs, 2)
    hashes = {w: packing.document_terms(pa.array([w]))[0][0] for w in held}
    assert [w for w in sorted(held) if corpus.frequency(np.array([hashes[w]]))[0]] == ["a", "b"]
    dealt, _ = packing.with_rest(docs, corpus, spark.sparkContext.broadcast(corpus))
    for row in dealt.collect():
        expected = {int(hashes[w].view(np.int64)): held[w] for w in row["__text__"].split() if w in "ce"}
        assert dict(zip(row["__rare__"] or [], row["__held__"] or [])) == expected


def test_words_of_all_kinds_are_encoded_as_by_the_library():
    r = random.Random(2)
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))] * 3 + list("\x01\x7f\u0100\u00b4\uac00")
    words = ["".join(r.choice(chars[94:] if k % 2 else chars) for _ in range(r.randint(1, 7))) for k in range(3000)]
    ids, ends = ChunkEncoder(PATH, "word").encode(pa.array([" ".join(words), *words[:50]]))
    library = Tokenizer.from_file(PATH)
    for k, t in enumerate([" ".join(words), *words[:50]]):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
