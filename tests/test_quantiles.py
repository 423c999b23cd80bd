"""Percentiles by selection equal the built-in ones, whatever the ties, and never gather a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlane.functions.quantiles import percentiles
from patchlane.operators import metrics, pooling

SHARES = [0.0, 0.01, 1 / 3, 0.5, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [("even", float(v)) for v in rng.random(3000)] + [("heavy", float(v)) for v in rng.lognormal(0, 4, 2500)] + [("ties", float(v)) for v in rng.integers(0, 3, 2000)]
    rows += [("same", 7.0)] * 900 + [("mostly", 1.0)] * 1500 + [("mostly", float(v)) for v in range(-5, 6)] + [("one", -2.5), (None, 4.0), (None, 6.0), ("even", None), ("none", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("limit", [60, 1 << 20])
def test_percentiles_equal_the_built_in(values, limit):
    made = {r.k: r.p for r in percentiles(values, ["k"], "v", SHARES, "p", limit).collect()}
    said = {r.k: r.p for r in values.groupBy("k").agg(F.percentile("v", SHARES).alias("p")).collect()}
    assert made == {k: p for k, p in said.items() if p is not None} and len(made) == 7


def test_without_keys_and_empty(values):
    assert percentiles(values, [], "v", [0.5], "p", 100).first().p == [values.agg(F.percentile("v", 0.5)).first()[0]]
    assert percentiles(values.limit(0), ["k"], "v", [0.5]).collect() == []


def test_maps_and_thresholds_do_not_gather(spark):
    rng = np.random.default_rng(1)
    rows = [("m", i, y, x, i % 2, bool(i % 2 and y < 3), float(rng.random())) for i in range(6) for y in range(8) for x in range(8)]
    cells = spark.createDataFrame(rows, "method string, image_id long, y int, x int, label int, mask boolean, value double")
    regions = cells.where("mask").select("image_id", "y", "x", F.col("image_id").alias("region_id"), "method")
    scaled = pooling.normalize_maps(cells)
    overlap = metrics.region_overlap(cells, regions, keys=("method",), stride=2)
    for made in (scaled, overlap):
        assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
    p99 = np.quantile([r[-1] for r in rows if r[4] == 0], 0.99)
    np.testing.assert_allclose(sorted(r.value for r in scaled.collect()), np.sort(np.clip(np.array([r[-1] for r in rows]) / p99, 0, 2)))
    normal = [r[-1] for r in rows if r[2] % 2 == 0 and r[3] % 2 == 0 and not r[5]]
    for r in overlap.collect():
        own = [q[-1] for q in rows if q[1] == r.image_id and q[5]]
        assert r.overlap == pytest.approx(np.mean(np.array(own) > np.quantile(normal, 1 - r.fpr)))
