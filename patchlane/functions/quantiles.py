"""Exact percentiles of groups of any size, by selection.

The built-in exact percentile keeps all distinct values of a group in one buffer. Here the values of a wanted rank are found
by counting: approximate quantiles cut a group into ranges, exact counts of the ranges tell which of them holds the rank,
and that range is cut again until it has at most `limit` rows, which are ranked. Cuts only say where to count; the result
does not depend on their error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

CUTS = 64
#: Rows of a group that are ranked in one task.
LIMIT = 1 << 20


def _inside(points: DataFrame, states: DataFrame) -> DataFrame:
    """k, rank, below and v of the points in each open range (lo, hi) of their group."""
    by = states.groupBy("k").agg(F.collect_list(F.struct("rank", "below", "lo", "hi")).alias("s"))  # two for each share
    fits = lambda s: (s["lo"].isNull() | (F.col("v") > s["lo"])) & (s["hi"].isNull() | (F.col("v") < s["hi"]))
    return points.join(by, "k").select("k", "v", F.explode(F.filter("s", fits)).alias("s")).select("k", "v", "s.*")


def values_at(points: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """k, rank and value: of each group's values in ascending order the one with that many before it.

    points: k, v (a table that is read in each round); wanted: k, rank."""
    states = wanted.select("k", "rank", F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    found = None
    while True:
        inside = _inside(points, states)
        cuts = stored(inside.groupBy("k", "rank").agg(F.count("*").alias("n"), F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 1_000).alias("cuts")))
        open_ = cuts.where(F.col("n") > limit).select("k", "rank", F.array_distinct("cuts").alias("cuts"))
        if open_.isEmpty():
            break
        # Odd ranges hold the values of one cut, even ones those between two of them.
        place = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        parts = inside.join(open_, ["k", "rank"]).groupBy("k", "rank", "below", "lo", "hi", "cuts", place.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("n").over(Window.partitionBy("k", "rank").orderBy("part")) - F.col("n")  # at most 2 * CUTS rows
        parts = parts.withColumn("before", before + F.col("below")).where("rank >= before and rank < before + n")
        half = (F.col("part") / 2).cast("int")
        chosen = stored(parts.select("k", "rank", F.col("before").alias("below"), "least", "most", F.coalesce(F.when(half > 0, F.get("cuts", half - 1)), "lo").alias("lo"), F.coalesce(F.get("cuts", half), "hi").alias("hi")))
        whole = chosen.where("least = most").select("k", "rank", F.col("least").alias("value"))
        found = whole if found is None else found.unionByName(whole)
        few = states.join(open_, ["k", "rank"], "left_anti")
        states = stored(few.unionByName(chosen.where("least < most").select(*states.columns)))
    counted = inside.groupBy("k", "rank", "below", "v").agg(F.count("*").alias("n"))
    until = F.sum("n").over(Window.partitionBy("k", "rank").orderBy("v")) + F.col("below")
    ranked = counted.withColumn("until", until).where("rank >= until - n and rank < until").select("k", "rank", F.col("v").alias("value"))
    return ranked if found is None else ranked.unionByName(found)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], out: str = "percentiles", limit: int = LIMIT) -> DataFrame:
    """keys and an array of the interpolated percentiles of value, equal to F.percentile's; groups without a value have none."""
    key = F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit(0).alias("all"))
    points = stored(df.where(F.col(value).isNotNull()).select(key.alias("k"), F.col(value).cast("double").alias("v")))
    sizes = stored(points.groupBy("k").agg(F.count("*").alias("n")))
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    at = values_at(points, sizes.select("k", F.explode(ranks).alias("rank")), limit)
    known = at.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m")).join(sizes, "k")

    def between(p):
        low, high = F.element_at("m", F.floor(p)), F.element_at("m", F.ceil(p))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return known.select(*[F.col(f"k.{c}").alias(c) for c in keys], F.array(*[between(p) for p in places]).alias(out))
