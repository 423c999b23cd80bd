"""Grid operators on cells (image_id, y, x, value).

Coordinate changes are plain projections. Smoothing gathers each image once into an array, whose size is the image's own,
and filters both axes in Arrow batches; resampling joins target cells with their source cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graphs import roots
from ..functions.mathx import hash_draw
from ..functions.shared import stored

#: Sides of the tiles that grids are cut into; a grid within one is a group of its own.
TILE = 1024
VIEW_SETS = {"none": (0.0,), "rot4": (0.0, 90.0, 180.0, 270.0), "rot8": tuple(45.0 * k for k in range(8)), "rot16": tuple(22.5 * k for k in range(16)), "small": (0.0, 15.0, -15.0, 30.0, -30.0)}


def hflip(cells: DataFrame, width: int) -> DataFrame:
    return cells.withColumn("x", F.lit(width - 1) - F.col("x"))


def dihedral(cells: DataFrame, height: int, width: int) -> DataFrame:
    """The eight views of each grid: view = quarter turns (counter-clockwise) + 4 for a flip before them."""
    rows = cells.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x = F.when(F.col("view") >= 4, F.lit(width - 1) - F.col("x")).otherwise(F.col("x"))
    y, turn = F.col("y"), F.col("view") % 4
    new_y = F.when(turn == 0, y).when(turn == 1, F.lit(width - 1) - x).when(turn == 2, F.lit(height - 1) - y).otherwise(x)
    new_x = F.when(turn == 0, x).when(turn == 1, y).when(turn == 2, F.lit(width - 1) - x).otherwise(F.lit(height - 1) - y)
    return rows.select(*[c for c in rows.columns if c not in ("y", "x")], new_y.cast("int").alias("y"), new_x.cast("int").alias("x"))


def mirror(i: Column, n: int, border: str) -> Column:
    """A coordinate brought into 0 .. n - 1: reflect (edge repeated), reflect101 (edge once) or nearest."""
    if border == "nearest" or n == 1:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
    period = 2 * n if border == "reflect" else 2 * n - 2
    m = F.pmod(i, F.lit(period))
    return F.when(m < n, m).otherwise(F.lit(period - 1 if border == "reflect" else period) - m)


def affine(
    cells: DataFrame, height: int, width: int, angle: Column | None, scale: Column | float = 1.0, dy: float = 0.0, dx: float = 0.0, interp: str = "bilinear", border: str = "reflect101", value: str = "value", views: Sequence[float] = (), tile: int = TILE
) -> DataFrame:
    """Rotate by angle (degrees, counter-clockwise) and scale about (width/2, height/2), then shift.

    angle and scale may depend on the image's other columns. Every target cell takes its source place; bilinear weighs the
    four neighbours, nearest takes one. border reflect101 mirrors, reflect and nearest repeat the edge, zero takes 0
    outside. With views, every image is resampled once for each of these angles (column angle instead of the argument).
    A grid within a tile is gathered once, as smoothing does, and all its views are made from that. Of a larger one (dense)
    each tile of a view is made from the tiles that its turned box touches, so a group is a few tiles."""
    others = [c for c in cells.columns if c not in ("y", "x", value)]
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    whole = max(height, width) <= tile
    cell = F.struct((F.col("y").cast("long") * width + F.col("x")).alias("i"), F.col(value).cast("double").alias("v"))
    place = [] if whole else [tile_of("y", tile).alias("__by"), tile_of("x", tile).alias("__bx")]
    images = cells.groupBy(*others, *place).agg(F.array_sort(F.collect_list(cell)).alias("__c"))
    images = images.select(*others, *images.columns[len(others) : -1], F.transform("__c", lambda c: c["i"]).alias("__i"), F.transform("__c", lambda c: c["v"]).alias("__v"))
    cy, cx = height / 2, width / 2

    def source(y, x, degrees, by, cos, sin):
        """Row and column that a target place is taken from; numbers or Columns."""
        down, right = y - cy - dy, x - cx - dx
        return (sin * right + cos * down) / by + cy, (cos * right - sin * down) / by + cx

    if whole:
        if views:
            images, angle, others = images.withColumn("angle", F.explode(F.array(*map(F.lit, views)))), F.col("angle"), [*others, "angle"]
        tiles = images.select(*others, "__i", "__v", F.lit(-1).alias("__ty"), F.lit(-1).alias("__tx"), angle.cast("double").alias("__angle"), scale.cast("double").alias("__scale"))
    else:
        images = stored(images)
        wanted = images.select(*others).distinct()
        named = list(others)
        if views:
            wanted, angle, named = wanted.withColumn("angle", F.explode(F.array(*map(F.lit, views)))), F.col("angle"), [*others, "angle"]
        wanted = wanted.select(*named, angle.cast("double").alias("__angle"), scale.cast("double").alias("__scale"))
        for c, n in (("__ty", height), ("__tx", width)):
            wanted = wanted.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit((n - 1) // tile))))
        ends = {c: (F.col(c) * tile, F.least((F.col(c) + 1) * tile, F.lit(n)) - 1) for c, n in (("__ty", height), ("__tx", width))}
        turn = F.radians("__angle")
        corners = [source(y, x, None, F.col("__scale"), F.cos(turn), F.sin(turn)) for y in ends["__ty"] for x in ends["__tx"]]
        for k, (c, n) in enumerate((("__by", height), ("__bx", width))):
            low, high = (fn(*[p[k] for p in corners]) for fn in (F.least, F.greatest))
            low, high = F.floor(low) - 2, F.ceil(high) + 2  # the taps and rounding
            inner = F.when(low < 0, 0).otherwise(low), F.when(high >= n, n - 1).otherwise(high)
            if border in ("reflect", "reflect101"):  # what is folded back stands as far inside as it was outside
                inner = F.when(high >= n, F.least(inner[0], 2 * n - 2 - high)).otherwise(inner[0]), F.when(low < 0, F.greatest(inner[1], -low)).otherwise(inner[1])
            clip = lambda v, n=n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
            wanted = wanted.withColumns({f"{c}0": F.floor(clip(inner[0]) / tile).cast("int"), f"{c}1": F.floor(clip(inner[1]) / tile).cast("int")})
        for c in ("__by", "__bx"):
            wanted = wanted.withColumn(c, F.explode(F.sequence(F.least(f"{c}0", f"{c}1"), F.greatest(f"{c}0", f"{c}1"))))
        others = named
        joined = wanted.join(images, [c for c in images.columns if c not in ("__i", "__v")])
        tiles = joined.groupBy(*others, "__ty", "__tx", "__angle", "__scale").agg(F.flatten(F.collect_list("__i")).alias("__i"), F.flatten(F.collect_list("__v")).alias("__v"))

    def fold(i: np.ndarray, n: int) -> np.ndarray:
        if border == "nearest" or n == 1:
            return i.clip(0, n - 1)
        m = i % (2 * n if border == "reflect" else 2 * n - 2)
        return np.where(m < n, m, (2 * n - 1 if border == "reflect" else 2 * n - 2) - m)

    @F.pandas_udf("struct<i: array<bigint>, v: array<double>>")
    def warp(places: pd.Series, values: pd.Series, ty: pd.Series, tx: pd.Series, angles: pd.Series, scales: pd.Series) -> pd.DataFrame:
        made = []
        for at, v, i, j, degrees, by in zip(places, values, ty, tx, angles, scales, strict=True):
            top, left = (0, 0) if i < 0 else ((at // width).min(), (at % width).min())
            grid = np.zeros((height, width) if i < 0 else ((at // width).max() - top + 1, (at % width).max() - left + 1))
            grid[at // width - top, at % width - left] = v
            if i >= 0:
                rows, columns = (np.arange(t * tile, min((t + 1) * tile, n)) for t, n in ((i, height), (j, width)))
                at = (rows[:, None] * width + columns).ravel()
            cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
            sy, sx = (np.round(c, 9) for c in source(at // width, at % width, degrees, by, cos, sin))
            if interp == "nearest":
                taps = [(np.floor(sy + 0.5).astype(int), np.floor(sx + 0.5).astype(int), np.ones(len(at)))]
            else:
                y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
                fy, fx = sy - y0, sx - x0
                taps = [(y0 + a, x0 + b, (fy if a else 1 - fy) * (fx if b else 1 - fx)) for a in (0, 1) for b in (0, 1)]
            out = np.zeros(len(at))
            for y, x, w in taps:
                inside = (y >= 0) & (y < height) & (x >= 0) & (x < width) if border == "zero" else np.ones(len(at), bool)
                y, x = (y.clip(0, height - 1), x.clip(0, width - 1)) if border == "zero" else (fold(y, height), fold(x, width))
                inside &= w > 0
                out[inside] += w[inside] * grid[y[inside] - top, x[inside] - left]
            made.append((at, out))
        return pd.DataFrame(made, columns=["i", "v"])

    made = tiles.select(*others, warp("__i", "__v", "__ty", "__tx", "__angle", "__scale").alias("__w"))
    rows = made.select(*others, F.explode(F.arrays_zip(F.col("__w.i").alias("i"), F.col("__w.v").alias("v"))).alias("__o"))
    return rows.select(*others, F.expr(f"cast(__o.i div {width} as int)").alias("y"), (F.col("__o.i") % width).cast("int").alias("x"), F.col("__o.v").alias(value))


def rotate_views(cells: DataFrame, height: int, width: int, views: str | Sequence[float] = "rot8") -> DataFrame:
    """Rotated copies of each grid, one for each angle, which is a column."""
    return affine(cells, height, width, None, views=VIEW_SETS[views] if isinstance(views, str) else tuple(views))


def random_angles(images: DataFrame, n: int = 30, seed: int = 0) -> DataFrame:
    """The original (angle 0) and n - 1 angles of 0 .. 345 in steps of 15, drawn by hash."""
    draw = hash_draw(F.lit(seed), F.col("image_id"), F.col("k")) % 24 * 15
    rows = images.select("image_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("angle", F.when(F.col("k") == 0, 0).otherwise(draw).cast("double"))


def perturb(cells: DataFrame, kind: str, level: float, seed: int = 0, height: int = 0, width: int = 0, value: str = "value") -> DataFrame:
    """brightness: times level; gain: times 1 - level, 1 or 1 + level by the image's number; noise: normal with that
    deviation; all rounded and clipped to 0 .. 255. blur: a Gaussian of that radius."""
    v = F.col(value)
    if kind == "blur":
        return gaussian_smooth(cells, level, height, width, value=value)
    if kind == "brightness":
        made = v * level
    elif kind == "gain":
        made = v * (1 + (F.col("image_id") % 3 - 1) * level)
    elif kind == "noise":
        key = [F.lit(seed), F.col("image_id"), F.col("y"), F.col("x")]
        u1, u2 = (hash_draw(*key) + 1) / F.lit(4294967297.0), hash_draw(*key, F.lit("b")) / F.lit(4294967296.0)
        made = v + level * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    else:
        raise ValueError(f"unknown perturbation {kind}")
    return cells.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(made))))


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian cut at four deviations, from -radius to radius."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def axis_weights(lo: int, hi: int, n: int, w: Sequence[float], border: str) -> tuple[int, np.ndarray]:
    """Weights of the source places for the places lo .. hi - 1 of an axis of n places, and the first of those sources: a
    kernel's reach around them, cut at the grid's edges, where the border folds what is outside back into it."""
    radius = len(w) // 2
    first, last = max(lo - radius, 0), min(hi + radius, n)
    period = 2 * n if border == "reflect" else max(2 * n - 2, 1)
    fold = {"nearest": lambda i: min(max(i, 0), n - 1), "reflect": lambda i: min(i % period, period - 1 - i % period), "reflect101": lambda i: min(i % period, period - i % period)}[border]
    out = np.zeros((hi - lo, last - first))
    for i in range(lo, hi):
        for k, weight in enumerate(w):
            out[i - lo, fold(i + k - radius) - first] += weight
    return first, out


def gaussian_smooth(cells: DataFrame, sigma: float, height: int, width: int, keys: Sequence[str] = ("image_id",), value: str = "value", border: str = "reflect", tile: int = TILE) -> DataFrame:
    """Separable Gaussian smoothing of dense grids; sigma 0 changes nothing.

    A grid within a tile is one group. A larger one is cut into tiles, and cells go to every tile that the kernel reaches
    them from, so a group is a tile and its halo, whatever the grid's size."""
    if sigma == 0:
        return cells
    w = kernel(sigma)
    radius = len(w) // 2
    if max(height, width) > tile and radius >= tile:
        raise ValueError(f"a kernel of radius {radius} does not fit tiles of {tile}")
    rows = cells.select(*keys, "y", "x", F.col(value).cast("double").alias("v"))
    for c, n in (("y", height), ("x", width)):
        reached = F.sequence(F.expr(f"cast(greatest({c} - {radius}, 0) div {tile} as int)"), F.expr(f"cast(least({c} + {radius}, {n - 1}) div {tile} as int)"))
        rows = rows.withColumn(f"__t{c}", F.explode(reached) if n > tile else F.lit(0))
    flat = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda c: c["v"])
    tiles = rows.groupBy(*keys, "__ty", "__tx").agg(flat.alias("__v"))

    @F.pandas_udf("array<double>")
    def both(values: pd.Series, ty: pd.Series, tx: pd.Series) -> pd.Series:
        known: dict = {}

        def weights(t: int, n: int) -> np.ndarray:
            if (t, n) not in known:
                known[t, n] = axis_weights(t * tile, min((t + 1) * tile, n), n, w, border)[1]
            return known[t, n]

        made = []
        for v, i, j in zip(values, ty, tx, strict=True):
            down, across = weights(i, height), weights(j, width)
            made.append((down @ np.asarray(v, float).reshape(down.shape[1], across.shape[1]) @ across.T).ravel())
        return pd.Series(made)

    out = tiles.select(*keys, "__ty", "__tx", both("__v", "__ty", "__tx").alias("__a"))
    side = F.least(F.lit(tile), F.lit(width) - F.col("__tx") * tile)
    placed = out.select(*keys, "__ty", "__tx", side.alias("__w"), F.posexplode("__a").alias("__i", value))
    return placed.select(*keys, (F.expr("cast(__i div __w as int)") + F.col("__ty") * tile).alias("y"), (F.col("__i") % F.col("__w") + F.col("__tx") * tile).alias("x"), value)


def upsample(cells: DataFrame, height: int, width: int, new_height: int, new_width: int, align: str = "corner", keys: Sequence[str] = ("image_id",), value: str = "value") -> DataFrame:
    """Bilinear resize: corner maps out to out * (n - 1) / (N - 1), center to (out + 0.5) * n / N - 0.5 within the grid."""

    def axis(n: int, new: int, name: str) -> Column:
        out = []
        for i in range(new):
            s = (i * (n - 1) / (new - 1) if new > 1 else 0.0) if align == "corner" else min(max((i + 0.5) * n / new - 0.5, 0.0), n - 1.0)
            s = round(s, 9)
            a = min(int(s), n - 1)
            b = min(a + 1, n - 1)
            out += [F.struct(F.lit(i).alias(f"t{name}"), F.lit(p).alias(name), F.lit(f).alias(f"w{name}")) for p, f in ((a, 1 - (s - a)), (b, s - a)) if f > 0]
        return F.array(*out)

    # The two axes' tables are as small as the grid's sides; each source cell goes to the targets that take it.
    spark = cells.sparkSession
    ty, tx = (spark.range(1).select(F.explode(axis(n, new, name)).alias("a")).select("a.*") for n, new, name in ((height, new_height, "y"), (width, new_width, "x")))
    sent = cells.select(*keys, "y", "x", F.col(value).cast("double").alias("__v")).join(F.broadcast(ty), "y").join(F.broadcast(tx), "x")
    return sent.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("__v") * F.col("wy") * F.col("wx")).alias(value))


def resize_nearest(mask: DataFrame, height: int, width: int, new_height: int, new_width: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Set cells (y, x) of a binary mask at the new size: the target takes source floor((out + 0.5) * n / N)."""
    source = lambda out, n, new: F.floor((F.col(out) + 0.5) * n / new).cast("int")

    def span(c: str, n: int, new: int) -> Column:  # targets that may take the source
        low, high = F.floor(F.col(c) * new / n) - 1, F.ceil((F.col(c) + 1) * new / n) + 1
        return F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(new - 1)).cast("int"))

    sent = mask.select(*keys, "y", "x").withColumn("ty", F.explode(span("y", height, new_height))).where(source("ty", height, new_height) == F.col("y"))
    sent = sent.withColumn("tx", F.explode(span("x", width, new_width))).where(source("tx", width, new_width) == F.col("x"))
    return sent.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"))


def resize_area(cells: DataFrame, factor: int, keys: Sequence[str] = ("image_id",), value: str = "value") -> DataFrame:
    return cells.groupBy(*keys, F.expr(f"cast(y div {factor} as int)").alias("y"), F.expr(f"cast(x div {factor} as int)").alias("x")).agg(F.avg(value).alias(value))


def _moved(mask: DataFrame, offsets: Sequence[tuple[int, int]], height: int, width: int) -> DataFrame:
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets]))
    rows = mask.select("image_id", "y", "x", moves.alias("m"))
    return rows.select("image_id", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).where(f"y between 0 and {height - 1} and x between 0 and {width - 1}")


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(a, b) for a in range(-r, k - r) for b in range(-r, k - r)]


def dilate(mask: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Set cells of a mask dilated by a k x k square."""
    return _moved(mask, square(k), height, width).distinct()


def erode(mask: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Cells all of whose k x k neighbours inside the grid are set."""
    r = k // 2
    found = _moved(mask, square(k), height, width).groupBy("image_id", "y", "x").agg(F.count("*").alias("n"))
    reach = lambda c, n: F.least(F.col(c) + r, F.lit(n - 1)) - F.greatest(F.col(c) - r, F.lit(0)) + 1
    return found.where(F.col("n") == reach("y", height) * reach("x", width)).select("image_id", "y", "x")


def close(mask: DataFrame, k: int, height: int, width: int) -> DataFrame:
    return erode(dilate(mask, k, height, width), k, height, width)


def dilate_cross(mask: DataFrame, iterations: int, height: int, width: int) -> DataFrame:
    """Dilation by the 4-neighbour cross, iterated: all cells within that city-block distance."""
    r = iterations
    offsets = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a) + abs(b) <= r]
    return _moved(mask, offsets, height, width).distinct()


def label_cells(pdf: pd.DataFrame, connectivity: int) -> pd.DataFrame:
    """The set cells of one image or tile with their region's first cell in row order, as y * 65536 + x."""
    steps = [(0, -1), (-1, 0)] + ([(-1, -1), (-1, 1)] if connectivity == 8 else [])
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    place = y * 65536 + x
    root = np.arange(len(place))
    edges = []
    for dy, dx in steps:
        at = np.searchsorted(place, place + dy * 65536 + dx)
        at = np.minimum(at, len(place) - 1)
        hit = np.flatnonzero((place[at] == place + dy * 65536 + dx) & (x + dx >= 0))
        edges.append(np.stack([hit, at[hit]]))
    a, b = np.concatenate(edges, axis=1)
    while True:  # least label over edges, with pointer jumping
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        np.minimum.at(least, root, least)
        least = least[least]
        if np.array_equal(least, root):
            break
        root = least
    return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y, "x": x, "region_id": place[root]})


REGIONS = "image_id long, y int, x int, region_id long"


def connected_components(mask: DataFrame, connectivity: int = 4, height: int | None = None, width: int | None = None, tile: int = TILE) -> DataFrame:
    """image_id, y, x and region_id (the region's first cell in row order, as y * 65536 + x) of set cells.

    Grids within a tile are a group each. Others are cut into tiles, which are labelled alone; cells that touch
    over a seam link their tiles' labels, and the links' components rename these. No group is larger than a tile."""
    cells = mask.select("image_id", "y", "x")
    if height is None or width is None:
        height, width = (n + 1 for n in cells.agg(F.coalesce(F.max("y"), F.lit(0)), F.coalesce(F.max("x"), F.lit(0))).first())
    if max(height, width) <= tile:
        return cells.groupBy("image_id").applyInPandas(lambda pdf: label_cells(pdf, connectivity), REGIONS)
    labelled = stored(tile_labels(cells, connectivity, tile))
    merged = roots(seam_links(labelled, connectivity, tile), ["image_id"]).select("image_id", F.col("node").alias("region_id"), "root")
    return labelled.join(merged, ["image_id", "region_id"], "left").select("image_id", "y", "x", F.coalesce("root", "region_id").alias("region_id"))


def tile_of(column: str, tile: int) -> Column:
    return F.expr(f"cast({column} div {tile} as int)")


def tile_labels(cells: DataFrame, connectivity: int, tile: int) -> DataFrame:
    """Regions of each tile alone."""
    return cells.groupBy("image_id", tile_of("y", tile), tile_of("x", tile)).applyInPandas(lambda pdf: label_cells(pdf, connectivity), REGIONS)


def seam_links(labelled: DataFrame, connectivity: int, tile: int) -> DataFrame:
    """image_id, a, b: labels of neighbouring cells of different tiles. Only cells beside a seam are looked at."""
    first, last = (lambda c, k=k: F.col(c) % tile == k for k in (0, tile - 1))
    border = labelled.where(first("y") | first("x") | last("y") | last("x"))
    crossing = {(0, -1): first("x"), (-1, 0): first("y")}
    if connectivity == 8:
        crossing |= {(-1, -1): first("y") | first("x"), (-1, 1): first("y") | last("x")}
    steps = F.array(*[F.when(c, F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))) for (dy, dx), c in crossing.items()])
    asked = border.select("image_id", "y", "x", F.col("region_id").alias("a"), F.explode(steps).alias("s")).where("s is not null")
    asked = asked.select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "a")
    return asked.join(border.withColumnRenamed("region_id", "b"), ["image_id", "y", "x"]).where("a != b").select("image_id", "a", "b").distinct()


def region_stats(regions: DataFrame, height: int, width: int, band: int = 1) -> DataFrame:
    """Area of each region, and whether it reaches the border band."""
    edge = F.max(((F.col("y") < band) | (F.col("x") < band) | (F.col("y") >= height - band) | (F.col("x") >= width - band)).cast("int")) == 1
    return regions.groupBy("image_id", "region_id").agg(F.count("*").alias("area"), edge.alias("edge"))


def tta_average(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    keys = ["image_id", "y", "x"]
    return a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys).select(*keys, ((F.col("__a") + F.col("__b")) / 2).alias(value))


def stride(cells: DataFrame, step: int = 4) -> DataFrame:
    return cells.where((F.col("y") % step == 0) & (F.col("x") % step == 0))


def aspect_extent(images: DataFrame, shorter: int, patch: int) -> DataFrame:
    """new_h and new_w of images (h, w): the shorter side scaled to `shorter`, both cut down to a multiple of patch."""
    scale = F.lit(float(shorter)) / F.least("h", "w")
    cut = lambda c: (F.floor(F.round(F.col(c) * scale) / patch) * patch).cast("int")
    return images.withColumns({"new_h": cut("h"), "new_w": cut("w")})


def crop_border(cells: DataFrame, b: int, height: int, width: int) -> DataFrame:
    return cells.where(f"y >= {b} and x >= {b} and y < {height - b} and x < {width - b}")


def foreground_mask(patches: DataFrame, threshold: float = 10.0, least_share: float = 0.35) -> DataFrame:
    """keep for every patch (image_id, gy, gx): first principal component of the image's own vectors above the threshold;
    where the central 60 % holds no more than least_share of set patches, the component's other sign; then a 3 x 3
    dilation and a closing. A group is one image."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["vec"].to_numpy()).astype(float)
        _, _, axes = np.linalg.svd(v - v.mean(0), full_matrices=False)
        pc = (v - v.mean(0)) @ axes[0]
        pc *= np.sign(axes[0][np.abs(axes[0]).argmax()]) or 1
        h, w = int(pdf["gy"].max()) + 1, int(pdf["gx"].max()) + 1
        grid = np.zeros((h, w))
        grid[pdf["gy"], pdf["gx"]] = pc
        a, b = round(h * 0.2), round(w * 0.2)
        on = grid > threshold
        if on[a : h - a, b : w - b].mean() <= least_share:
            on = -grid > threshold
        grow = lambda m: np.max([np.pad(m, 1)[i : i + h, j : j + w] for i in range(3) for j in range(3)], 0)
        shrink = lambda m: np.min([np.pad(m, 1, constant_values=True)[i : i + h, j : j + w] for i in range(3) for j in range(3)], 0)
        on = shrink(grow(grow(on)))
        return pd.DataFrame({"image_id": pdf["image_id"], "gy": pdf["gy"], "gx": pdf["gx"], "keep": on[pdf["gy"], pdf["gx"]].astype(bool)})

    return patches.groupBy("image_id").applyInPandas(one, "image_id long, gy int, gx int, keep boolean")


def apply_mask(scores: DataFrame, keep: DataFrame, keys: Sequence[str] = ("image_id", "gy", "gx"), value: str = "value") -> DataFrame:
    """Scores of masked-out patches become 0."""
    return scores.join(keep, list(keys), "left").withColumn(value, F.when(F.col("keep"), F.col(value)).otherwise(0.0)).drop("keep")


def valid_patches(height: int, width: int, cells: DataFrame, patch: int, least: float = 0.75) -> DataFrame:
    """Patches of warped grids of ones whose mean is at least `least`."""
    others = [c for c in cells.columns if c not in ("y", "x", "value")]
    blocks = cells.groupBy(*others, F.expr(f"cast(y div {patch} as int)").alias("py"), F.expr(f"cast(x div {patch} as int)").alias("px")).agg(F.avg("value").alias("share"))
    return blocks.where(F.col("share") >= least)


def masks_of(cells: DataFrame, mask: str = "mask") -> DataFrame:
    return cells.where(F.col(mask)).select("image_id", "y", "x")


