"""Ranking and localization metrics by key: AUROC, AP, F1, TPR at an FPR, AU-PRO, AUsPRO, overlaps.

Curves are cumulative sums over distinct scores (or score levels), never over rows, so ties are one point; these points are
written to the shared folder once and read for cuts, sums and totals. `keys` may be
empty; cumulative() adds partition sums first, so that no task gets a whole curve."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from ..functions.shared import stored

BINS = 1 << 16


#: Points of a key whose running sums one task takes.
DIRECT = 1 << 20


def cumulative(points: DataFrame, keys: Sequence[str], score: str, values: Sequence[str], buckets: int = 64, direct: int = DIRECT) -> DataFrame:
    """Running sums of values by falling score within each key, and the same one point before (as cum_v and pre_v).

    Keys of at most `direct` points, by count, take one window. Otherwise scores are cut into ranges of about equal numbers
    of points, at approximate quantiles, so that a heavy tail does not put all points into one range; sums within a range
    and over ranges are separate windows, so the work of one key is spread over `buckets` tasks."""
    most = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= direct:
        return running(points, keys, score, values)
    steps = [i / buckets for i in range(1, buckets)]
    cuts = points.groupBy(*keys).agg(F.percentile_approx(score, steps, 2_000).alias("__cuts"))
    rows = points.join(cuts, list(keys)) if keys else points.join(F.broadcast(cuts))
    rows = rows.withColumn("__range", F.size(F.filter("__cuts", lambda c: c > F.col(score))))
    inner = Window.partitionBy(*keys, "__range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__range").agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    before = sums.select(*keys, "__range", *[F.coalesce(F.sum(f"__sum_{v}").over(outer), F.lit(0)).alias(f"__before_{v}") for v in values])
    out = rows.join(before, [*keys, "__range"])
    cums = {f"cum_{v}": F.sum(v).over(inner) + F.col(f"__before_{v}") for v in values}
    out = out.withColumns(cums).withColumns({f"pre_{v}": F.col(f"cum_{v}") - F.col(v) for v in values})
    return out.drop("__cuts", "__range", *[f"__before_{v}" for v in values])


#: Names of a curve's running sums.
CURVE = {"cum_pos": "tp", "cum_neg": "fp", "pre_pos": "tp0", "pre_neg": "fp0"}


def running(points: DataFrame, keys: Sequence[str], score: str, values: Sequence[str]) -> DataFrame:
    """cumulative() with each key's points in one window."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values}).withColumns({f"pre_{v}": F.col(f"cum_{v}") - F.col(v) for v in values})


def curve(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """One point for each distinct score: tp, fp (and before it), n_pos, n_neg; keys without either kind drop out."""
    flag = F.col(label).cast("int")
    points = stored(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(flag).alias("pos"), F.sum(1 - flag).alias("neg")))
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).where("n_pos > 0 and n_neg > 0")
    made = cumulative(points, keys, "score", ["pos", "neg"])
    made = made.join(totals, list(keys)) if keys else made.join(F.broadcast(totals))
    return made.withColumnsRenamed(CURVE)


def auroc_of() -> Column:
    return F.sum((F.col("fp") - F.col("fp0")) / F.col("n_neg") * (F.col("tp") + F.col("tp0")) / (2 * F.col("n_pos"))).alias("auroc")


def ap_of() -> Column:
    return F.sum((F.col("tp") - F.col("tp0")) / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap")


def f1_of() -> Column:
    return F.max(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos"))).alias("f1_max")


def auroc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    return curve(df, label, score, keys).groupBy(*keys).agg(auroc_of().alias("auroc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    return curve(df, label, score, keys).groupBy(*keys).agg(ap_of().alias("ap"))


def f1_max(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    return curve(df, label, score, keys).groupBy(*keys).agg(f1_of().alias("f1_max"))


def tpr_at_fpr(df: DataFrame, target: float, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """TPR of the last point whose FPR is within the target; 0 if none is."""
    within = F.col("fp") <= F.col("n_neg") * target
    return curve(df, label, score, keys).groupBy(*keys).agg(F.coalesce(F.max(F.when(within, F.col("tp") / F.col("n_pos"))), F.lit(0.0)).alias("tpr"))


def pixel_metrics(cells: DataFrame, label: str = "mask", score: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    return curve(cells, label, score, keys).groupBy(*keys).agg(auroc_of().alias("pixel_auroc"), ap_of().alias("pixel_ap"))


def pro_weights(cells: DataFrame, regions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """cells with w: 1 / (pixels of the cell's region * regions of the key) for cells in a region, else 0."""
    sizes = regions.groupBy(*keys, "image_id", "region_id").agg(F.count("*").alias("size"))
    n = sizes.groupBy(*keys).agg(F.count("*").alias("regions"))
    named = regions.select(*keys, "image_id", "y", "x", "region_id").join(sizes, [*keys, "image_id", "region_id"])
    named = named.join(n, list(keys)) if keys else named.join(F.broadcast(n))
    weighted = named.select(*keys, "image_id", "y", "x", (1 / (F.col("size") * F.col("regions"))).alias("w"))
    return cells.join(weighted, [*keys, "image_id", "y", "x"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def _area(points: DataFrame, keys: Sequence[str], limits: Sequence[float]) -> DataFrame:
    """Area under (fpr, pro) up to each limit, the last segment cut by linear interpolation, divided by the limit."""
    points = points.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    x0, x1 = F.col("pre_neg") / F.col("n_neg"), F.col("cum_neg") / F.col("n_neg")
    y0, y1 = F.col("pre_w"), F.col("cum_w")
    cut = F.least(x1, F.col("limit"))
    height = F.when(x1 > x0, y0 + (y1 - y0) * (cut - x0) / (x1 - x0)).otherwise(y1)
    part = F.when(x0 < F.col("limit"), (cut - x0) * (y0 + height) / 2).otherwise(0.0)
    return points.groupBy(*keys, "limit").agg((F.sum(part) / F.col("limit")).alias("aupro"))


def aupro(cells: DataFrame, regions: DataFrame, limits: Sequence[float] = (0.3,), keys: Sequence[str] = (), mask: str = "mask", score: str = "value") -> DataFrame:
    """Exact AU-PRO: one point for each distinct score. Keys without defects or normal pixels drop out."""
    rows = pro_weights(cells, regions, keys)
    return _points_area(rows.withColumn("score", F.col(score)), mask, keys, limits)


def _points_area(rows: DataFrame, mask: str, keys: Sequence[str], limits: Sequence[float]) -> DataFrame:
    neg = (~F.col(mask)).cast("int")
    points = stored(rows.groupBy(*keys, "score").agg(F.sum(neg).alias("neg"), F.sum("w").alias("w")))
    totals = points.groupBy(*keys).agg(F.sum("neg").alias("n_neg"), F.sum("w").alias("all_w")).where("n_neg > 0 and all_w > 0")
    made = cumulative(points, keys, "score", ["neg", "w"])
    made = made.join(totals, list(keys)) if keys else made.join(F.broadcast(totals))
    return _area(made, keys, limits)


def score_levels(cells: DataFrame, score: str, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """cells with score as one of `bins` levels between the key's least and largest score; a constant map has level 0."""
    extent = cells.groupBy(*keys).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    rows = cells.join(extent, list(keys)) if keys else cells.join(F.broadcast(extent))
    width = F.col("__hi") - F.col("__lo")
    level = F.when(width > 0, F.floor((F.col(score) - F.col("__lo")) * ((bins - 1) / width))).otherwise(0)
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(bins - 1), level)).cast("int")).drop("__lo", "__hi")


def aupro_binned(cells: DataFrame, regions: DataFrame, limits: Sequence[float] = (0.3,), keys: Sequence[str] = (), mask: str = "mask", score: str = "value", bins: int = BINS) -> DataFrame:
    """AU-PRO, pixel AUROC and pixel AP over score levels; several limits share one pass."""
    rows = score_levels(pro_weights(cells, regions, keys), score, keys, bins)
    neg = (~F.col(mask)).cast("int")
    # At most `bins` points a key: one table and one window serve all the curves.
    points = stored(rows.groupBy(*keys, "score").agg(F.sum(neg).alias("neg"), F.sum(1 - neg).alias("pos"), F.sum("w").alias("w")))
    totals = points.groupBy(*keys).agg(F.sum("neg").alias("n_neg"), F.sum("pos").alias("n_pos"), F.sum("w").alias("all_w")).where("n_neg > 0 and all_w > 0")
    made = running(points, keys, "score", ["neg", "pos", "w"])
    made = made.join(totals, list(keys)) if keys else made.join(F.broadcast(totals))
    areas = _area(made, keys, limits)
    pixels = made.withColumnsRenamed(CURVE).where("n_pos > 0").groupBy(*keys).agg(auroc_of().alias("pixel_auroc"), ap_of().alias("pixel_ap"))
    return areas.join(pixels, list(keys)) if keys else areas.join(F.broadcast(pixels))


def map_variants(variants: Mapping[str, DataFrame], mask: DataFrame, limits: Sequence[float] = (0.3,)) -> DataFrame:
    """AU-PRO, pixel AUROC and AP of each variant of the same maps (cells image_id, y, x, value), a row for each limit.

    mask holds the set cells (image_id, y, x); its 4-connected regions are found once for all variants."""
    from .grid import connected_components

    maps = None
    for name, frame in variants.items():
        own = frame.select("image_id", "y", "x", "value").withColumn("variant", F.lit(name))
        maps = own if maps is None else maps.unionByName(own)
    cells = maps.join(mask.select("image_id", "y", "x", F.lit(True).alias("mask")), ["image_id", "y", "x"], "left").fillna(False, ["mask"])
    regions = connected_components(mask).withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    return aupro_binned(cells, regions, limits, ["variant"])


def auspro(cells: DataFrame, regions: DataFrame, alpha: float = 0.3, mask: str = "mask", score: str = "value", thresholds: int = 100) -> DataFrame:
    """AUsPRO over thresholds spread evenly from the largest to the least pixel of normal images (no interpolation).

    A pixel counts from the first threshold it reaches, found by arithmetic; counts by threshold are then accumulated."""
    images = cells.groupBy("image_id").agg(F.max(F.col(mask)).alias("bad"))
    rows = pro_weights(cells, regions).join(images, "image_id")
    extent = rows.where("not bad").agg(F.max(score).alias("hi"), F.min(score).alias("lo")).where("hi is not null")
    step = (F.col("hi") - F.col("lo")) / (thresholds - 1)
    # The least k with value >= hi - k * step; the division's rounding is put right by looking at its neighbours.
    guess = F.ceil((F.col("hi") - F.col(score)) / step)
    threshold = lambda k: F.col("hi") - k * step
    k = F.when(F.col(score) >= threshold(guess - 1), guess - 1).when(F.col(score) >= threshold(guess), guess).otherwise(guess + 1)
    first = F.when(step > 0, F.greatest(k, F.lit(0))).otherwise(F.when(F.col(score) >= F.col("hi"), 0).otherwise(thresholds))
    reached = rows.join(F.broadcast(extent)).withColumn("k", first).where(F.col("k") < thresholds)
    by = reached.groupBy("k").agg(F.sum((~F.col("bad")).cast("long")).alias("fp"), F.sum("w").alias("w"))
    whole = rows.agg(F.sum((~F.col("bad")).cast("long")).alias("n"), F.sum("w").alias("all_w")).where("n > 0 and all_w > 0")
    w = Window.orderBy("k")  # at most `thresholds` rows
    steps = by.join(F.broadcast(whole)).select("k", (F.sum("fp").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("n")).alias("fpr"), F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spro"))
    steps = steps.where(F.col("fpr") <= alpha)
    area = steps.select(((F.col("fpr") - F.lag("fpr").over(w)) * (F.col("spro") + F.lag("spro").over(w)) / 2).alias("part"))
    return area.agg((F.sum("part") / alpha).alias("auspro"))


def membership(df: DataFrame, group: Column | str, name: str = "cond") -> DataFrame:
    """Each row in its own group and once more in 'all'."""
    group = F.col(group) if isinstance(group, str) else group
    return df.withColumn(name, F.explode(F.array(group.cast("string"), F.lit("all"))))


def aupro_by_condition(cells: DataFrame, regions: DataFrame, condition: Column, limits: Sequence[float] = (0.3,)) -> DataFrame:
    return aupro(membership(cells, condition), membership(regions, condition), limits, ["cond"])


def ap_by_kind(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """AP of the anomalous images of each kind, with all normal images on both sides."""
    own = F.when(F.col("label") == 1, F.array("kind")).otherwise(F.array(*map(F.lit, kinds)))
    return average_precision(df.withColumn("kind", F.explode(own)), keys=["kind"])


def region_overlap(cells: DataFrame, regions: DataFrame, fprs: Sequence[float] = (0.05, 0.01), keys: Sequence[str] = ("dataset",), stride: int = 4, mask: str = "mask", score: str = "value") -> DataFrame:
    """Share of each region's pixels strictly above the (1 - fpr) quantile of the normal pixels of a stride grid."""
    normal = cells.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0) & ~F.col(mask))
    thresholds = percentiles(normal, keys, score, [1 - f for f in fprs], "t")
    pairs = thresholds.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, fprs)).alias("fpr"), F.col("t").alias("thr"))).alias("p")).select(*keys, "p.*")
    pixels = cells.join(regions.select("image_id", "y", "x", "region_id"), ["image_id", "y", "x"])
    above = pixels.join(pairs, list(keys)).groupBy(*keys, "image_id", "region_id", "fpr").agg(F.avg((F.col(score) > F.col("thr")).cast("double")).alias("overlap"))
    return above


def image_pixel_ap(cells: DataFrame, methods: Sequence[str], mask: str = "mask") -> DataFrame:
    """Pixel AP of each image for each method's score column, and the first method's gain over the best other one."""
    long = cells.select("image_id", mask, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])).alias("s"))
    made = average_precision(long.select("image_id", F.col(mask).cast("int").alias("label"), "s.method", "s.score"), keys=["image_id", "method"])
    wide = made.groupBy("image_id").pivot("method", list(methods)).agg(F.max("ap"))
    best = F.greatest(*methods[1:]) if len(methods) > 2 else F.col(methods[1])
    return wide.withColumn("gain", F.col(methods[0]) - best)


def defect_area(cells: DataFrame, category: Column, mask: str = "mask") -> DataFrame:
    """Median share of the mask over images that have one, in percent."""
    shares = cells.groupBy("image_id").agg(F.avg(F.col(mask).cast("double")).alias("share"), F.sum(F.col(mask).cast("long")).alias("n")).where("n > 0")
    return shares.groupBy(category.alias("dataset")).agg((F.percentile("share", 0.5) * 100).alias("median_area_pct"))
