"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum by key and a join, so no neighbourhood is ever gathered, whatever its size; the number of rounds
grows with the logarithm of the largest component's size. Each round is written to the shared folder, which cuts the
lineage and survives lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, shared_dir

#: Rounds are about the logarithm of the largest component; more than these mean an error, and raise.
MAX_ROUNDS = 99


def as_edges(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct edges (u > v) of links of any direction."""
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return whole.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """For edges (u, v): u's least neighbour m, or u itself, beside every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    joined = _star(edges)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def settle(edges: DataFrame, name: str, folder: str) -> DataFrame:
    """Edges (u > v) after steps of both kinds until nothing changes: every node but a component's least one has a single
    edge, to that one. Steps are written to the folder, and each is deleted after the next."""
    state = None
    for k in range(MAX_ROUNDS):
        before, edges = edges, materialize(small_star(large_star(edges)), f"{name}-{k}", folder)
        if k:
            drop_table(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now
    raise RuntimeError(f"the components are not settled after {MAX_ROUNDS} rounds")


def nodes_of(edges: DataFrame) -> DataFrame:
    """node and component of settled edges."""
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """node and component (the component's least node) for every node that has a link to another one.

    Links may repeat and may point either way; a null end makes no link."""
    folder = folder or shared_dir(links.sparkSession)
    return nodes_of(settle(materialize(as_edges(links, a, b), "edges", folder), "edges", folder))
