"""Result statistics: category means, paired and cluster bootstraps, groups by size, slopes, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_draw

def benchmark() -> Column:
    """The benchmark of a category name: what stands before the slash."""
    return F.split_part(F.col("dataset"), F.lit("/"), F.lit(1))


def per_n(runs: DataFrame, metric: str = "metric", keys: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Mean over draws for each number of references."""
    return runs.where(F.col(metric).isNotNull()).groupBy(*keys, "n_train").agg(F.avg(metric).alias("by_n"))


def category_means(runs: DataFrame, ns: Sequence[int], metric: str = "metric", keys: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Mean over draws, then over the required n, times 100; null where an n is missing."""
    both = per_n(runs, metric, keys).where(F.col("n_train").isin(*ns)).groupBy(*keys).agg(F.avg("by_n").alias("m"), F.count("*").alias("n"))
    return both.select(*keys, F.when(F.col("n") == len(ns), F.col("m") * 100).alias("mean"))


def complete_methods(means: DataFrame) -> DataFrame:
    """Methods with a mean in every category that any method has."""
    all_ = means.agg(F.count_distinct("dataset").alias("all_categories"))
    have = means.where(F.col("mean").isNotNull()).groupBy("method").agg(F.count_distinct("dataset").alias("have"))
    return have.join(F.broadcast(all_)).where("have = all_categories").select("method")


def with_groups(means: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Each row once for its benchmark, once for 'all', and once for each group of its benchmark (benchmark, grp)."""
    rows = means.withColumn("benchmark", benchmark())
    base = rows.withColumn("grp", F.explode(F.array("benchmark", F.lit("all"))))
    return base if groups is None else base.unionByName(rows.join(F.broadcast(groups), "benchmark"))


def flag_best(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """best: equal to the largest value of its group after rounding to one decimal."""
    top = F.max(F.round(value, 1)).over(Window.partitionBy(*by))
    return df.withColumn("best", F.round(value, 1) == top)


def summary_table(means: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Mean by method and group, with the best of each group flagged."""
    return flag_best(with_groups(means, groups).groupBy("method", "grp").agg(F.avg("mean").alias("value")), "value", ["grp"])


def per_n_table(runs: DataFrame, metric: str = "metric") -> DataFrame:
    by = per_n(runs, metric).groupBy("n_train", "method").agg((F.avg("by_n") * 100).alias("value"))
    return flag_best(by, "value", ["n_train"])


def paired(means: DataFrame, x: str, y: str) -> DataFrame:
    """d = x - y for each category that both methods cover."""
    wide = means.groupBy("dataset").agg(F.max(F.when(F.col("method") == x, F.col("mean"))).alias("x"), F.max(F.when(F.col("method") == y, F.col("mean"))).alias("y"))
    return wide.where("x is not null and y is not null").withColumn("d", F.col("x") - F.col("y"))


def replicates(units: DataFrame, values: Sequence[str], b: int, seed: int = 0, by: Sequence[str] = (), order: str = "dataset") -> DataFrame:
    """b resamples of the units with replacement: the sums of the values over each resample, and its size.

    The draw of place i in resample r is a hash of (seed, r, i), so any engine can repeat it. Only units are resampled (one
    row a category), whatever the number of rows behind them; resamples are spread over the cluster."""
    numbered = units.withColumn("unit", F.row_number().over(Window.partitionBy(*by, F.lit(0)).orderBy(order)) - 1)
    size = Window.partitionBy(*by, F.lit(0))
    numbered = numbered.withColumn("units", F.count("*").over(size))
    groups = numbered.select(*by, "units").distinct()
    draws = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0), (F.col("units") - 1).cast("int"))))
    draws = draws.withColumn("unit", hash_draw(F.lit(seed), F.col("rep"), F.col("place")) % F.col("units"))
    drawn = draws.groupBy(*by, "rep", "unit").agg(F.count("*").alias("times"))
    return drawn.join(numbered, [*by, "unit"]).groupBy(*by, "rep").agg(*[F.sum(F.col(v) * F.col("times")).alias(v) for v in values], F.sum("times").alias("drawn"))


def interval(reps: DataFrame, value: Column, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic over the resamples; resamples without a value are left out."""
    tail = (1 - level) / 2
    return reps.select(*by, value.alias("v")).where("v is not null").groupBy(*by).agg(F.percentile("v", tail).alias("lo"), F.percentile("v", 1 - tail).alias("hi"))


def paired_bootstrap(pairs: DataFrame, b: int = 10_000, seed: int = 0, by: Sequence[str] = (), margin: float = 0.5) -> DataFrame:
    """Mean difference with its 95 % interval, wins, ties (within the margin) and losses, and the number of categories."""
    d = F.col("d")
    point = pairs.groupBy(*by).agg(
        F.avg("d").alias("mean"), F.sum((d > margin).cast("long")).alias("wins"), F.sum((F.abs(d) <= margin).cast("long")).alias("ties"), F.sum((d < -margin).cast("long")).alias("losses"), F.count("*").alias("n")
    )
    ci = interval(replicates(pairs, ["d"], b, seed, by), F.col("d") / F.col("drawn"), by)
    return point.join(ci, list(by)) if by else point.join(F.broadcast(ci))


def win_tie_loss(pairs: DataFrame, margin: float = 0.5) -> DataFrame:
    d = F.col("d")
    return pairs.agg(F.sum((d > margin).cast("long")).alias("wins"), F.sum((F.abs(d) <= margin).cast("long")).alias("ties"), F.sum((d < -margin).cast("long")).alias("losses"))


def gain_by_benchmark(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(benchmark().alias("benchmark")).agg(F.avg("d").alias("gain"), F.count("*").alias("n"))


def leave_one_out(pairs: DataFrame, b: int = 10_000, seed: int = 0) -> DataFrame:
    """The paired bootstrap without each benchmark in turn."""
    names = pairs.select(benchmark().alias("left_out")).distinct()
    # Pairs are one row a category and benchmarks a handful, so the product is small by construction.
    kept = pairs.join(F.broadcast(names), benchmark() != F.col("left_out"))
    return paired_bootstrap(kept, b, seed, ["left_out"])


def terciles(df: DataFrame, size: str) -> DataFrame:
    """size_class small, medium or large by the linear thirds of a column."""
    q = df.agg(F.percentile(size, 1 / 3).alias("q1"), F.percentile(size, 2 / 3).alias("q2"))
    label = F.when(F.col(size) <= F.col("q1"), "small").when(F.col(size) <= F.col("q2"), "medium").otherwise("large")
    return df.join(F.broadcast(q)).withColumn("size_class", label).drop("q1", "q2")


def within_slope(df: DataFrame, x: Column, y: Column, group: Sequence[str | Column]) -> DataFrame:
    """Ordinary least-squares slope of y on x with a fixed effect for each group; null where x varies in no group.

    The mean of equal numbers can be off by rounding, so groups of one x are told by their extremes."""
    w = Window.partitionBy(*group)
    made = df.withColumn("__x", x).withColumn("__y", y)
    dx = F.when(F.min("__x").over(w) == F.max("__x").over(w), F.col("__x") * 0).otherwise(F.col("__x") - F.avg("__x").over(w))
    centred = made.withColumn("__dx", dx).withColumn("__dy", F.col("__y") - F.avg("__y").over(w))
    return centred.agg((F.sum(F.col("__dx") * F.col("__dy")) / F.nullif(F.sum(F.col("__dx") * F.col("__dx")), F.lit(0.0))).alias("slope"), F.count("*").alias("n"))


def cluster_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, b: int = 2_000, seed: int = 0) -> DataFrame:
    """A ratio of sums and its interval over resampled clusters; resamples whose denominator is 0 are left out."""
    sums = df.groupBy(cluster).agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den"))
    point = sums.agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("value"))
    ci = interval(replicates(sums, ["num", "den"], b, seed, order=cluster), F.col("num") / F.nullif(F.col("den"), F.lit(0.0)))
    return point.join(F.broadcast(ci))


def region_size_gain(regions: DataFrame, gain: str = "gain") -> DataFrame:
    """Gain by region size class (thirds of distinct regions' area): mean of category means."""
    sized = terciles(regions.dropDuplicates(["dataset", "image_id", "region_id"]), "area")
    by = sized.groupBy("size_class", "dataset").agg(F.avg(gain).alias("g"), F.count("*").alias("k"))
    return by.groupBy("size_class").agg(F.avg("g").alias("gain"), F.sum("k").alias("regions"), F.count("*").alias("categories"))


def gain_by_condition(df: DataFrame, x: str, y: str) -> DataFrame:
    wide = df.groupBy("cond").pivot("method", [x, y]).agg(F.avg("metric"))
    return wide.select("cond", F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) - F.col(y)).alias("gain"))


def ablation_table(runs: DataFrame, ns: Sequence[int], x: str, y: str) -> DataFrame:
    """Means with all benchmarks weighing alike: draws, n, categories, benchmarks; null where a category has a gap."""
    means = category_means(runs, ns).withColumn("benchmark", benchmark())
    categories = means.groupBy("benchmark").agg(F.count_distinct("dataset").alias("need"))
    by = means.where("mean is not null").groupBy("method", "benchmark").agg(F.avg("mean").alias("m"), F.count_distinct("dataset").alias("have")).join(categories, "benchmark")
    whole = by.groupBy("method").agg(F.avg("m").alias("m"), F.sum("have").alias("have"))
    need = F.broadcast(categories.agg(F.sum("need").alias("all_need")))
    value = F.when(F.col("have") == F.col("all_need"), F.col("m"))
    pick = lambda m: F.max(F.when(F.col("method") == m, value))
    return whole.join(need).agg(pick(x).alias("x"), pick(y).alias("y"), (pick(x) - pick(y)).alias("difference"))


def cost_table(costs: DataFrame) -> DataFrame:
    """Means by n and method over finite rows, the largest relative difference, and images a second."""
    fine = costs.where(~F.isnan("score_ms") & (F.abs("score_ms") < float("inf")))
    return fine.groupBy("n_train", "method").agg(
        F.avg("fit_s").alias("fit_s"), F.avg("score_ms").alias("score_ms"), F.max("rel_diff").alias("max_rel_diff"), (1000 / F.avg(F.col("forward_ms") + F.col("score_ms"))).alias("images_per_s")
    )


def benchmark_table(images: DataFrame) -> DataFrame:
    """Categories, normal and anomalous images, and the anomalous share of each benchmark."""
    return images.groupBy(benchmark().alias("benchmark")).agg(
        F.count_distinct("dataset").alias("categories"), F.sum((F.col("label") == 0).cast("long")).alias("normal"), F.sum((F.col("label") == 1).cast("long")).alias("anomalous"), F.avg((F.col("label") == 1).cast("double")).alias("share")
    )


def numbers_table(table: DataFrame, name: Column, values: Sequence[str], decimals: int = 1) -> DataFrame:
    """One row (name, value as text) for each cell."""
    cells = F.array(*[F.struct(F.concat_ws(".", name, F.lit(v)).alias("name"), F.col(v).cast("double").alias("v")) for v in values])
    long = table.select(F.explode(cells).alias("c")).where("c.v is not null")
    return long.select("c.name", F.round(F.col("c.v"), decimals).cast(f"decimal(20,{decimals})").cast("string").alias("value"))


def median_category(means: DataFrame) -> DataFrame:
    """For each benchmark, the category nearest to its median; ties by name."""
    rows = means.where("mean is not null").withColumn("benchmark", benchmark())
    mid = rows.groupBy("benchmark").agg(F.percentile("mean", 0.5).alias("median"))
    gap = F.struct(F.round(F.abs(F.col("mean") - F.col("median")), 9).alias("gap"), F.col("dataset"))
    return rows.join(mid, "benchmark").groupBy("benchmark").agg(F.min(gap).alias("g")).select("benchmark", F.col("g.dataset").alias("dataset"))


def median_area_image(images: DataFrame) -> DataFrame:
    """For each category, the image in the middle by area (of an even number the later)."""
    w = Window.partitionBy("dataset")
    ranked = images.withColumn("k", F.row_number().over(w.orderBy("area", "image_id"))).withColumn("n", F.count("*").over(w))
    return ranked.where("k = n div 2 + 1").select("dataset", "image_id", "area")


def top_gain_categories(gains: DataFrame, limit: int = 6) -> DataFrame:
    """The largest gains over the best other method, at most one a benchmark."""
    rows = gains.withColumn("benchmark", benchmark())
    first = F.row_number().over(Window.partitionBy("benchmark").orderBy(F.desc(F.round("gain", 9)), "dataset"))
    return rows.withColumn("k", first).where("k = 1").drop("k").orderBy(F.desc(F.round("gain", 9)), "dataset").limit(limit)


def curve_by_n(runs: DataFrame, metric: str = "metric") -> DataFrame:
    """Mean by n of the methods that cover every category with every n."""
    by = per_n(runs, metric)
    need = F.broadcast(by.agg((F.count_distinct("dataset") * F.count_distinct("n_train")).alias("need")))
    full = by.groupBy("method").agg(F.count("*").alias("have")).join(need).where("have = need").select("method")
    return by.join(F.broadcast(full), "method").groupBy("method", "n_train").agg((F.avg("by_n") * 100).alias("value"))


def timing_medians(times: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return times.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median_ms"), F.count("*").alias("images"))
