"""The composed calls: from reference features to models, from models and test features to image scores and pixel maps.

Defaults are those of the published method: 256 directions (or as many as there are), at most 12 components, shrinkage 2000,
chi-square tails, smoothing by one patch, the 95th percentile of each layer, maps of 16 cells a patch side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import chi2_tail_score
from ..functions.shared import stored
from . import grid, keyed, mixtures, pooling


@dataclass(frozen=True)
class Settings:
    directions: int = 256
    components: int = 12
    kappa: float = 2000.0
    sigma: float = 1.0
    percentile: str = "p95"
    patch: int = 16
    seed: int = 0
    #: Keys whose vectors come to at most so many bytes are fitted in one group each; with larger ones all go by rounds.
    group_bytes: int = 512 << 20


def fit(refs: DataFrame, keys: Sequence[str] = ("layer",), settings: Settings = Settings(), row_id: str = "row_id", vec: str = "vec") -> DataFrame:
    """A model table (mixtures.MODEL) of the references of every key: patches of all views of all reference images, each
    named by row_id. Every vector counts; which of the two fits is taken depends on the largest key's measured bytes."""
    refs = stored(refs.select(*keys, row_id, vec))
    size = F.count("*") * F.max(F.size(vec)) * 8
    largest, width = refs.groupBy(*keys).agg(size.alias("bytes"), F.max(F.size(vec)).alias("width")).agg(F.max("bytes"), F.max("width")).first()
    d = min(settings.directions, width or settings.directions)
    if (largest or 0) <= settings.group_bytes:
        return mixtures.fit_by_key(refs, keys, settings.components, d, settings.kappa, row_id, vec, limit=settings.group_bytes, seed=settings.seed)
    return keyed.fit(refs, keys, settings.components, d, settings.kappa, row_id, vec, settings.seed)


def patch_scores(patches: DataFrame, models: DataFrame, keys: Sequence[str] = ("layer",), vec: str = "vec") -> DataFrame:
    """patches with value: the chi-square tail of the least squared distance to a component of their key's model."""
    models = stored(models)
    d = models.agg(F.max(F.size("evals"))).first()[0]  # all models of a fit have as many directions
    scored = mixtures.score_by_key(patches, models, keys, vec)
    return scored.withColumn("value", chi2_tail_score(F.col("distance"), d or 1)).select(*patches.columns, "value")


def score(tests: DataFrame, models: DataFrame, side: int, keys: Sequence[str] = ("layer",), image_keys: Sequence[str] = ("image_id",), settings: Settings = Settings(), vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Image scores (image_keys, score) and pixel maps (image_keys, y, x, value) of test patches (image_keys, layer, gy, gx,
    vec) on grids of side x side patches. keys name a patch's model; they hold the layer."""
    per_layer = list(dict.fromkeys([*image_keys, "layer"]))
    cells = patch_scores(tests.select(*dict.fromkeys([*image_keys, *keys, "layer"]), "gy", "gx", vec), models, keys, vec)
    cells = cells.select(*per_layer, F.col("gy").alias("y"), F.col("gx").alias("x"), "value")
    maps = stored(grid.gaussian_smooth(cells, settings.sigma, side, side, per_layer))
    scores = pooling.layer_mean(pooling.pool(maps, settings.percentile, per_layer), tuple(image_keys))
    fused = pooling.fused_map(maps, (*image_keys, "y", "x"))
    return scores, grid.upsample(fused, side, side, settings.patch * side, settings.patch * side, "corner", image_keys)
