"""Grids larger than a tile: the same results as one group would give, and no group over a tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlane.functions.graphs import roots
from patchlane.operators import grid


def frame(spark, cells):
    y, x = np.nonzero(cells)
    return spark.createDataFrame([(1, int(a), int(b)) for a, b in zip(y, x, strict=True)], "image_id long, y int, x int").repartition(3)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tiled_components_equal_the_group_form(spark, connectivity):
    cells = np.random.default_rng(connectivity).random((70, 90)) < (0.6 if connectivity == 4 else 0.4)
    two = frame(spark, cells).unionByName(frame(spark, ~cells).withColumn("image_id", F.lit(2).cast("long")))
    whole, tiled = ({tuple(r) for r in grid.connected_components(two, connectivity, tile=t).collect()} for t in (128, 16))
    assert whole == tiled and len({r[:1] + r[3:] for r in whole}) > 5


def test_a_snake_through_all_tiles_is_one_region(spark):
    n, step, tile = 4000, 80, 512
    rows = spark.range(n // step).selectExpr("cast(id * 80 as int) as y", "explode(sequence(0, 3999)) as x")
    turns = spark.range(n // step - 1).selectExpr("explode(sequence(cast(id * 80 + 1 as int), cast(id * 80 + 79 as int))) as y", "if(id % 2 = 0, 3999, 0) as x")
    snake = rows.unionByName(turns).selectExpr("7L as image_id", "y", "x")
    found = grid.connected_components(snake, 4, n, n, tile)
    assert found.agg(F.count("*"), F.min("region_id"), F.max("region_id")).first()[:] == (50 * 4000 + 49 * 79, 0, 0)
    groups = snake.groupBy(grid.tile_of("y", tile), grid.tile_of("x", tile)).count()
    assert groups.count() == 64 and groups.agg(F.max("count")).first()[0] <= tile * tile
    # Cut once, it is two regions.
    cut = grid.connected_components(snake.where("not (y = 1600 and x = 2000)"), 8, n, n, tile)
    assert sorted(r[0] for r in cut.select("region_id").distinct().collect()) == [0, 1600 * 65536 + (2001 if 20 % 2 == 0 else 0)]


def test_components_of_links(spark):
    links = [("p", 3, 1), ("p", 5, 3), ("q", 3, 2), ("q", 2, 2), ("p", 1, 3)] + [("r", i, i + 1) for i in range(200)]
    found = {(r.k, r.node): r.root for r in roots(spark.createDataFrame(links, "k string, a long, b long"), ["k"]).collect()}
    assert found == {("p", 3): 1, ("p", 5): 1, ("q", 3): 2} | {("r", i): 0 for i in range(1, 201)}
    assert roots(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("border", ["reflect", "reflect101", "nearest"])
def test_tiled_smoothing_equals_the_whole_form(spark, border):
    v = np.random.default_rng(0).random((45, 70))
    cells = spark.createDataFrame([(1, y, x, float(v[y, x])) for y in range(45) for x in range(70)], "image_id long, y int, x int, value double").repartition(4)
    whole, tiled = (grid.gaussian_smooth(cells, 1.5, 45, 70, border=border, tile=t).toPandas().sort_values(["y", "x"]) for t in (128, 16))
    assert tiled[["y", "x"]].to_numpy().tolist() == whole[["y", "x"]].to_numpy().tolist() and len(tiled) == 45 * 70
    np.testing.assert_allclose(tiled["value"], whole["value"], atol=1e-13)
    with pytest.raises(ValueError):
        grid.gaussian_smooth(cells, 9.0, 45, 70, tile=16)


@pytest.mark.parametrize("border,interp,scale", [("reflect101", "bilinear", 1.0), ("zero", "bilinear", 0.7), ("nearest", "nearest", 1.3), ("reflect", "bilinear", 0.4)])
def test_tiled_views_equal_the_whole_form(spark, border, interp, scale):
    v = np.random.default_rng(1).random((2, 37, 50))
    cells = spark.createDataFrame([(i, y, x, float(v[i, y, x])) for i in range(2) for y in range(37) for x in range(50)], "image_id long, y int, x int, value double").repartition(4)
    order = ["image_id", "angle", "y", "x"]
    whole, tiled = (grid.affine(cells, 37, 50, None, scale, dy=1.5, border=border, interp=interp, views=(0.0, 30.0, 135.0, -100.0), tile=t).toPandas().sort_values(order) for t in (64, 16))
    assert whole[order].to_numpy().tolist() == tiled[order].to_numpy().tolist() and len(whole) == 2 * 4 * 37 * 50
    np.testing.assert_allclose(tiled["value"], whole["value"], atol=1e-12)


def test_flip_average_and_foreground(spark):
    """Averages with the mirrored map, and the mask of the first principal component, written out in numpy."""
    v = np.random.default_rng(2).random((3, 6, 5))
    flat = spark.createDataFrame([(i, y, x, float(v[i, y, x])) for i in range(3) for y in range(6) for x in range(5)], "image_id long, y int, x int, value double")
    made = grid.tta_average(flat, grid.hflip(flat.withColumn("value", F.col("value") * 2), 5)).toPandas().sort_values(["image_id", "y", "x"])
    np.testing.assert_allclose(made["value"].to_numpy().reshape(3, 6, 5), (v + 2 * v[:, :, ::-1]) / 2)

    rng, patches, expected = np.random.default_rng(3), [], {}
    for image in range(4):
        on = np.zeros((8, 8), bool)
        on[2:6, 2:6] = image % 2 == 0
        on[0, :] |= image % 2 == 1
        x = rng.normal(size=(64, 5)) * 0.1 + np.where(on.ravel()[:, None], 4.0, -1.0) * np.eye(5)[image % 5]
        patches += [(image, k // 8, k % 8, x[k].tolist()) for k in range(64)]
        c = x - x.mean(0)
        axis = np.linalg.svd(c)[2][0]
        pc = (c @ axis * np.sign(axis[np.abs(axis).argmax()])).reshape(8, 8)
        mask = pc > 1.0
        if mask[2:6, 2:6].mean() <= 0.35:
            mask = -pc > 1.0
        for grow in (True, True, False):
            padded = np.pad(mask, 1, constant_values=not grow)
            mask = np.array([[(padded[y : y + 3, z : z + 3].any() if grow else padded[y : y + 3, z : z + 3].all()) for z in range(8)] for y in range(8)])
        expected |= {(image, y, z): bool(mask[y, z]) for y in range(8) for z in range(8)}
    frame = spark.createDataFrame(patches, "image_id long, gy int, gx int, vec array<double>").repartition(3)
    keep = grid.foreground_mask(frame, 1.0)
    assert {(r.image_id, r.gy, r.gx): r.keep for r in keep.collect()} == expected and 20 < sum(expected.values()) < 250
    masked = grid.apply_mask(frame.select("image_id", "gy", "gx", F.lit(3.0).alias("value")), keep)
    assert {(r.image_id, r.gy, r.gx): r.value for r in masked.collect()} == {k: 3.0 * v for k, v in expected.items()}
