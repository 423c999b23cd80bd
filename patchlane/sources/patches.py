"""Patch features that arrive as a table of vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_patches(df: DataFrame, grid: int, layers: Mapping[str, tuple[int, int]], index: str = "vec_id", vec: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, layer, gy, gx and vec: grid x grid consecutive vectors are an image, a layer is a slice (first, length)."""
    n = grid * grid
    parts = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), F.slice(F.col(vec), a, size).cast("array<double>").alias("vec")) for name, (a, size) in layers.items()])).alias("l")
    place = F.col(index) % n
    return df.select(F.expr(f"{index} div {n}").alias("image_id"), F.expr(f"cast(({index} % {n}) div {grid} as int)").alias("gy"), (place % grid).cast("int").alias("gx"), *keep, parts).select("image_id", "l.layer", "gy", "gx", *keep, "l.vec")
