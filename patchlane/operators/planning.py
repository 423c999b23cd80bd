"""Work planning and result tables: grids of units, what is done or pending, shards, merging of result sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("dataset", "method", "n_train", "seed")


def work_grid(categories: DataFrame, **values: Sequence) -> DataFrame:
    """Every category with every combination of the given values; one output column for each argument."""
    out = categories
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return out


def pending(grid: DataFrame, runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Units of the grid without a result."""
    return grid.join(runs.select(*keys).distinct(), list(keys), "left_anti")


def done_units(runs: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Units with at least the expected number of rows."""
    return runs.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") >= expected)


def pending_counts(grid: DataFrame, runs: DataFrame, by: Sequence[str] = ("dataset",), keys: Sequence[str] = KEYS) -> DataFrame:
    return pending(grid, runs, keys).groupBy(*by).agg(F.count("*").alias("pending"))


def missing_scores(runs: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs without a stored score file."""
    return runs.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def interleave(categories: DataFrame, benchmark: Column, name: str = "dataset") -> DataFrame:
    """Categories in round-robin order over their benchmarks; position counts from 0."""
    ranked = categories.select(name, benchmark.alias("benchmark")).distinct()
    ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("benchmark").orderBy(name)))
    # Names of categories are few, so one ordering of all of them is no bottleneck.
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("turn", "benchmark")) - 1)


def shard(ordered: DataFrame, shards: int, position: str = "position") -> DataFrame:
    return ordered.withColumn("shard", F.col(position) % shards)


def merge_runs(sources: Sequence[DataFrame], keys: Sequence[str] = KEYS, order: str | None = None) -> DataFrame:
    """Union of result sources; of equal keys the row of the later source stays, within a source the last by order."""
    parts = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("__source"), *([F.desc(order)] if order else []))
    return out.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank", "__source")


def enrich_runs(runs: DataFrame, more: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs with columns of a rerun, null where it has none."""
    return runs.join(more.select(*keys, *columns), list(keys), "left")


def filter_runs(runs: DataFrame, datasets: Sequence[str] | None = None, prefix: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    if datasets is not None:
        runs = runs.where(F.col("dataset").isin(*datasets))
    if prefix is not None:
        runs = runs.where(F.col("dataset").startswith(prefix))
    return runs if allowed is None else runs.join(allowed, "dataset", "left_semi")


def exclude_units(grid: DataFrame, rules: DataFrame) -> DataFrame:
    """The grid without the units that match a rule's columns."""
    return grid.join(rules, rules.columns, "left_anti")
