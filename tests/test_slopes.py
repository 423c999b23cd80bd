"""Slopes within groups where x hardly varies or does not at all."""

import numpy as np
from pyspark.sql import functions as F

from patchlane.operators import stats


def slope(spark, rows):
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    return stats.within_slope(frame, F.log10("x"), F.col("y"), ["g"]).first()


def test_one_x_in_every_group_has_no_slope(spark):
    """Eleven times this area: their mean is not quite the area, and the slope was rounding over rounding."""
    rows = [(g, 5.2727272727272725, float(k * k % 7 + 0.1)) for g in "pqr" for k in range(11)]
    assert tuple(slope(spark, rows)) == (None, 33)


def test_groups_of_one_x_leave_the_others_slope(spark):
    x = np.random.default_rng(0).random(20) + 1
    varied = [("v", float(a), float(2 * np.log10(a) + 3)) for a in x]
    constant = [("c", 5.2727272727272725, float(k)) for k in range(11)]
    assert abs(slope(spark, varied + constant).slope - 2) < 1e-9 and abs(slope(spark, varied).slope - 2) < 1e-9
    missing = [("v", None, 1.0), ("n", None, 2.0)]
    assert abs(slope(spark, varied + missing).slope - 2) < 1e-9
