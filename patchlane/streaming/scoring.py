"""Stateless scores on streams: models are fitted in batch, patches of a stream are scored as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import chi2_tail_score
from ..operators.models import Mixture
from ..operators.scoring import mahalanobis


def score_stream(patches: DataFrame, models: Mapping[str, Mixture], d: int, key: str = "key", vec: str = "z") -> DataFrame:
    """A stream (or batch) of patches with the chi-square tail score of each; start it with writeStream as usual."""
    return mahalanobis(patches, models, key, vec).withColumn("score", chi2_tail_score(F.col("distance"), d))
