"""Image scores from score maps, fusion of layers, normalisation and peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles


def pool(cells: DataFrame, how: str = "p95", keys: Sequence[str] = ("image_id",), value: str = "value") -> DataFrame:
    """One score for each key: pN (interpolating percentile), mean, max, or top1pct (mean of the largest 1 %, at least one)."""
    if how == "top1pct":
        w = Window.partitionBy(*keys)
        ranked = cells.withColumn("__k", F.row_number().over(w.orderBy(F.desc(value)))).withColumn("__n", F.count("*").over(w))
        return ranked.where(F.col("__k") <= F.greatest(F.lit(1), F.floor(F.col("__n") * 0.01))).groupBy(*keys).agg(F.avg(value).alias("score"))
    if how in ("mean", "max"):
        made = F.avg(value) if how == "mean" else F.max(value)
    elif how.startswith("p") and how[1:].isdigit():
        made = F.percentile(value, int(how[1:]) / 100)
    else:
        raise ValueError(f"unknown pooling {how}")
    return cells.groupBy(*keys).agg(made.alias("score"))


def layer_mean(scores: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean over layers of pooled scores."""
    return scores.groupBy(*keys).agg(F.avg("score").alias("score"))


def fused_map(cells: DataFrame, keys: Sequence[str] = ("image_id", "y", "x"), value: str = "value") -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg(value).alias(value))


def z_fusion(cells: DataFrame, references: DataFrame, value: str = "value") -> DataFrame:
    """Each layer's map standardised by its mean and population deviation on the references, then averaged by cell."""
    stats = references.groupBy("layer").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = cells.join(F.broadcast(stats), "layer").withColumn(value, (F.col(value) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0))
    return fused_map(z.drop("__m", "__s"), value=value)


def normalize_maps(cells: DataFrame, keys: Sequence[str] = ("method",), value: str = "value") -> DataFrame:
    """Maps over the 99th percentile of the normal images' pixels of the same key, clipped to 0 .. 2.

    A key may hold any number of pixels, so its percentile is selected, not gathered."""
    scale = percentiles(cells.where("label = 0"), keys, value, [0.99]).select(*keys, F.get("percentiles", 0).alias("__p"))
    return cells.join(scale, list(keys)).withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col(value) / F.col("__p")))).drop("__p")


def peak_in_region(cells: DataFrame, mask: DataFrame, value: str = "value") -> DataFrame:
    """Place of each image's largest value (ties: least y, then x) and whether the mask's cells hold it."""
    peak = cells.groupBy("image_id").agg(F.min(F.struct((-F.col(value)).alias("v"), "y", "x")).alias("p")).select("image_id", "p.y", "p.x")
    return peak.join(mask.select("image_id", "y", "x", F.lit(True).alias("inside")).distinct(), ["image_id", "y", "x"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def pool_all(cells: DataFrame, hows: Sequence[str] = ("p95", "p99", "max", "top1pct")) -> DataFrame:
    """All poolings of all layers, a column each."""
    direct = [h for h in hows if h != "top1pct"]
    aggregates = [(F.max("value") if h == "max" else F.avg("value") if h == "mean" else F.percentile("value", int(h[1:]) / 100)).alias(h) for h in direct]
    out = cells.groupBy("image_id", "layer").agg(*aggregates)
    if "top1pct" in hows:
        out = out.join(pool(cells, "top1pct", ("image_id", "layer")).withColumnRenamed("score", "top1pct"), ["image_id", "layer"])
    return out
