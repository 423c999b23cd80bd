"""Numeric Column expressions: normal tail, log-sum-exp, vectors as arrays, hash draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def log_normal_tail(z: Column) -> Column:
    """log P(Z > z) of a standard normal Z, finite for any z: continued fraction in the tails, power series between."""
    def far(x: Column) -> Column:  # x >= 2
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: k / (x + t))
        return -x * x / 2 - F.lit(HALF_LOG_2PI) - F.log(x + fraction)

    start = F.struct(z.cast("double").alias("term"), z.cast("double").alias("sum"))
    step = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step, lambda s: s["sum"])
    middle = F.log(F.lit(0.5) - F.exp(-z * z / 2 - F.lit(HALF_LOG_2PI)) * series)
    return F.when(z >= 2, far(z)).when(z <= -2, F.log1p(-F.exp(far(-z)))).otherwise(middle)


def wilson_hilferty(x: Column, d: int) -> Column:
    """The standard normal value whose tail is about that of a chi-square value x with d degrees of freedom."""
    v = 2 / (9 * d)
    return (F.pow(x / F.lit(float(d)), F.lit(1 / 3)) - F.lit(1 - v)) / F.lit(math.sqrt(v))


def chi2_tail_score(x: Column, d: int) -> Column:
    return -log_normal_tail(wilson_hilferty(x, d))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hash_draw(*parts: Column) -> Column:
    """A number in 0 .. 2^32 - 1 that depends on the parts alone; any engine with md5 gives the same."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
