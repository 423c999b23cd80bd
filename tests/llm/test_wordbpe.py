import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from patchlane.llm import wordbpe

PATH = P.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t", "one two two", "one two two", "Ünïcode's   don't\x0bstop <|endoftext|> x" + "y" * 90, "né né " * 500, "　 a ﬁ", "0123 4,5;6", "\x1c\x85 q"]


@pytest.mark.parametrize("frequent", [0, 3, 1 << 20])
def test_equals_the_library_on_whole_texts(spark, frequent):
    own = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i if i != 3 else None, t, "extra") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again")], "doc_id long, text string, ids string")
    rows = wordbpe.encode_decode(docs, PATH, frequent=frequent).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = own.encode(TEXTS[3 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids
        assert (np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded) == (ids, len(ids), own.decode(ids, skip_special_tokens=False))


def test_empty_table(spark):
    assert wordbpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
