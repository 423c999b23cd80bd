"""Known answers and invariants of metrics, grids and models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlane.functions import mathx
from patchlane.operators import grid, metrics, models, planning, scoring, stats


@pytest.fixture(scope="module")
def squares(spark):
    """A 10 x 10 map that equals its 2 x 2 mask, and an empty image."""
    rows = [(i, y, x, float(i == 0 and 3 <= y < 5 and 4 <= x < 6)) for i in (0, 1) for y in range(10) for x in range(10)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, value double").withColumn("mask", F.col("value") > 0)


def test_perfect_separation(squares):
    regions = grid.connected_components(grid.masks_of(squares))
    assert metrics.aupro(squares, regions).first().aupro == pytest.approx(1)
    binned = metrics.aupro_binned(squares, regions, (0.3, 0.05)).collect()
    assert len(binned) == 2 and all(r.aupro == pytest.approx(1) and r.pixel_auroc == 1 for r in binned)
    assert metrics.auspro(squares, regions).count() == 1


def test_no_defect_gives_no_value(squares):
    empty = squares.where("image_id = 1")
    regions = grid.connected_components(grid.masks_of(squares))
    assert metrics.aupro(empty, regions.where("image_id = 1")).count() == 0


def test_random_maps(spark):
    r = np.random.default_rng(0)
    rows = [(i, y, x, float(v), 8 <= y < 16 and 8 <= x < 16) for i in range(6) for (y, x), v in np.ndenumerate(r.random((32, 32)))]
    cells = spark.createDataFrame(rows, "image_id long, y int, x int, value double, mask boolean")
    found = metrics.aupro(cells, grid.connected_components(grid.masks_of(cells))).first().aupro
    assert found == pytest.approx(0.15, abs=0.03)
    assert metrics.pixel_metrics(cells).first().pixel_auroc == pytest.approx(0.5, abs=0.05)


def test_auroc_of_reversed_scores_and_ties(spark):
    df = spark.createDataFrame([("a", i % 3 % 2, float(i % 5)) for i in range(60)] + [("b", 0, 1.0)], "k string, label int, score double")
    a = metrics.auroc(df, keys=["k"]).collect()
    b = metrics.auroc(df.withColumn("score", -F.col("score")), keys=["k"]).collect()
    assert len(a) == 1 and a[0].auroc + b[0].auroc == pytest.approx(1)


def test_tail_against_erfc(spark):
    z = [x / 7 for x in range(-90, 200)]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", mathx.log_normal_tail(F.col("z")).alias("t")).collect()
    for r in rows:
        assert r.t == pytest.approx(math.log(0.5 * math.erfc(r.z / math.sqrt(2))), rel=1e-9, abs=1e-15)


def test_smoothing_keeps_the_sum_and_rotation_by_zero_changes_nothing(spark, squares):
    c = squares.select("image_id", "y", "x", "value")
    assert grid.gaussian_smooth(c, 1.0, 10, 10).agg(F.sum("value")).first()[0] == pytest.approx(4)
    same = grid.affine(c, 10, 10, F.lit(0.0)).join(c.withColumnRenamed("value", "v"), ["image_id", "y", "x"])
    assert same.where("abs(value - v) > 1e-9").count() == 0
    twice = grid.hflip(grid.hflip(c, 10), 10)
    assert twice.exceptAll(c).count() == 0
    assert grid.dihedral(c, 10, 10).count() == 8 * 200


def test_components_of_a_snake_and_diagonals(spark):
    rows = [(0, 0, x) for x in range(9)] + [(0, 1, 8)] + [(0, 2, x) for x in range(9)] + [(1, i, i) for i in range(5)]
    m = spark.createDataFrame(rows, "image_id long, y int, x int")
    counts = lambda k: {r.image_id: r.n for r in grid.connected_components(m, k).groupBy("image_id").agg(F.count_distinct("region_id").alias("n")).collect()}
    assert counts(4) == {0: 1, 1: 5} and counts(8) == {0: 1, 1: 1}


def test_mixture_against_numpy(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 1, (80, 3)) for c in (-4, 0, 5)])
    df = spark.createDataFrame([(i, "k", v.tolist()) for i, v in enumerate(x)], "row_id long, key string, z array<double>").repartition(5)
    pca = models.fit_pca(df, "key", vec="z")["k"]
    assert pca.evals.sum() == pytest.approx(np.trace(np.cov(x.T)))
    fitted, trace = models.fit_mixture(df, "key", 3, {"k": pca.evals}, kappa=0.0, ridge=0.0, max_iter=10)
    assert all(b >= a - 1e-9 for a, b in zip(trace["k"], trace["k"][1:]))
    scored = scoring.mahalanobis(df, fitted).orderBy("row_id").collect()
    m = fitted["k"]
    expected = np.min([[(v - c) @ np.linalg.inv(s) @ (v - c) for c, s in zip(m.means, m.covs)] for v in x], 1)
    assert np.allclose([s.distance for s in scored], expected)
    assert scoring.precision_diff(df, fitted).first().max_rel_diff < 1e-3


def test_large_bank_in_blocks_equals_broadcast(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(0, 1, (60, 4)))], "row_id long, vec array<double>")
    q, b = df.where("row_id < 20"), df.where("row_id >= 20")
    for cosine in (True, False):
        small = {x.row_id: x.distance for x in scoring.knn(q, b, "row_id", cosine).collect()}
        monkeypatch.setattr(scoring, "BROADCAST_BYTES", 0)
        large = {x.row_id: x.distance for x in scoring.knn(q, b, "row_id", cosine, tile_rows=10).collect()}
        monkeypatch.undo()
        assert small == pytest.approx(large)


def test_component_cap():
    assert models.cap_components(500, 8, 12) == 12 and models.cap_components(30, 8, 12) == 2


def test_merge_runs_takes_the_later_source(spark):
    schema = "dataset string, method string, n_train int, seed int, metric double"
    a = spark.createDataFrame([("d", "m", 1, 0, 0.1), ("d", "m", 2, 0, 0.2)], schema)
    b = spark.createDataFrame([("d", "m", 1, 0, 0.9)], schema)
    assert {(r.n_train, r.metric) for r in planning.merge_runs([a, b]).collect()} == {(1, 0.9), (2, 0.2)}
    means = stats.category_means(planning.merge_runs([a, b]), [1, 2])
    assert means.first()["mean"] == pytest.approx(55)
    assert stats.category_means(a, [1, 2, 4]).first()["mean"] is None
