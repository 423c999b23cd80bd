"""What a task and its Python worker hold at once: batches of texts, and ranges of hashes while counting."""

from collections import Counter

import numpy as np
import pyarrow as pa

from patchlane.llm import counts, packing
from patchlane.plans.session import BATCH_BYTES, ship_package


def test_batches_to_python_are_small(spark):
    ship_package(spark)
    assert spark.conf.get(BATCH_BYTES) == "4m"
    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id as string), 2000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    made = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(made) > 20e6 and max(made) < 8e6


def test_counts_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(counts, "COUNT_BYTES", 64)
    texts = [f"w{k % 7} w{k % 50} v{k}" for k in range(300)]

    def count(part):
        keys, _, words = packing.document_terms(part)
        return *np.unique(keys, return_counts=True), [len(part), words]

    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    made = counts.range_counts(frame, count, 1).collect()
    held = Counter(w for t in texts for w in set(t.split()))
    expected = sorted(n for n in held.values() if n > 1)
    assert sorted(r.n for r in made if r.part >= 0) == expected and len({r.part for r in made if r.part >= 0}) > 20
    totals = Counter()
    for r in made:
        if r.part == counts.TOTALS:
            totals[r.hash] += r.n
    assert totals == {0: 300, 1: 900}
