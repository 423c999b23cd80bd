"""pipeline: shingles of a slice are made in blocks, and ranks have one byte."""

import numpy as np
import pyarrow as pa

from patchlane.llm import jaccard
from patchlane.llm.common import BLOCK_BYTES


def test_shingles_are_counted_in_blocks(spark, monkeypatch):
    held, given = [], []

    class Watched(jaccard.Sets):
        def __init__(self, texts, *more):
            given.append(texts.nbytes)
            super().__init__(texts, *more)

    def counted(texts, count, more_than):
        held.append(count)
        return spark.createDataFrame([(0, 5, 2)], "part long, hash long, n long")

    monkeypatch.setattr(jaccard, "Sets", Watched)
    monkeypatch.setattr(jaccard, "range_counts", counted)
    ranks = jaccard.frequent_shingles(spark.createDataFrame([("a",)], "text string"), "text", 5, 10)
    assert ranks.rank.dtype == np.uint8 and ranks(np.array([5, 6], np.uint64)).tolist() == [6, 0]
    texts = pa.array([" ".join(f"w{(k * 31 + j) % 5000}" for j in range(200)) for k in range(2000)] + [None, ""])
    hashes, n, more = held[0](texts)
    whole, times = np.unique(jaccard.Sets(texts, 5).hash, return_counts=True)
    assert (hashes == whole).all() and (n == times).all() and more == []
    assert len(given) > 6 and max(given[:-1]) < 2 * BLOCK_BYTES < given[-1]
