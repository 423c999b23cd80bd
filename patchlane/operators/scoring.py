"""Patch scores: Mahalanobis distances, likelihoods and tails of mixtures, nearest neighbours, subspace residuals.

Diagonal models are Column expressions; full covariances, nearest neighbours and subspaces are Arrow batches of matrix
algebra over a broadcast model or bank, whose size is checked."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import chi2_tail_score, logsumexp
from ..functions.shared import stored
from .models import Mixture

#: A bank of more bytes is not broadcast but cut into cells.
BROADCAST_BYTES = 200 << 20


def diagonal_distances(df: DataFrame, model: DataFrame, key: str = "key", vec: str = "z") -> DataFrame:
    """df with d2 and logdet, arrays by component, from a diagonal model (key, component, i, mean, var, log_w).

    The model is a few numbers a key and is joined as arrays."""
    by = model.groupBy(key, "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean", "var"))), lambda c: F.struct(c["mean"].alias("mean"), c["var"].alias("var"))).alias("c"), F.first("log_w").alias("log_w"))
    by = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "c", "log_w"))).alias("__m"))
    joined = df.join(F.broadcast(by), key)
    distance = lambda m: F.aggregate(F.zip_with(F.col(vec), m["c"], lambda v, c: (v - c["mean"]) * (v - c["mean"]) / c["var"]), F.lit(0.0), lambda s, x: s + x)
    logdet = lambda m: F.aggregate(m["c"], F.lit(0.0), lambda s, c: s + F.log(c["var"]))
    made = {"d2": F.transform("__m", distance), "logdet": F.transform("__m", logdet), "log_w": F.transform("__m", lambda m: m["log_w"])}
    return joined.withColumns(made).drop("__m")


def min_distance(d2: Column) -> Column:
    return F.array_min(d2)


def log_joint(d: int) -> Column:
    """log(w_k N_k(x)) by component, from d2, logdet and log_w."""
    return F.zip_with(F.zip_with("d2", "logdet", lambda a, b: -0.5 * (a + b + d * float(np.log(2 * np.pi)))), "log_w", lambda a, w: a + w)


def nll(d: int) -> Column:
    return -logsumexp(log_joint(d))


def weighted_tail(d: int) -> Column:
    """-log of the mixture-weighted chi-square tails."""
    return -logsumexp(F.zip_with("d2", "log_w", lambda x, w: w - chi2_tail_score(x, d)))


def volume_corrected() -> Column:
    """Least of d2 + logdet minus the mean logdet."""
    mean = F.aggregate("logdet", F.lit(0.0), lambda s, x: s + x) / F.size("logdet")
    return F.array_min(F.zip_with("d2", "logdet", lambda a, b: a + b)) - mean


def assignment_entropy(d: int) -> Column:
    joint = log_joint(d)
    norm = logsumexp(joint)
    p = F.transform(joint, lambda v: F.exp(v - norm))
    return -F.aggregate(p, F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.log(v)).otherwise(0.0))


def position_nll(df: DataFrame, prior: DataFrame, d: int) -> DataFrame:
    """Negative log-likelihood whose component weights are those of the patch's place (gy, gx, component,
    prior); every place has a prior for every component."""
    by = prior.groupBy("gy", "gx").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "prior"))), lambda c: F.log(c["prior"])).alias("place_w"))
    joined = df.join(F.broadcast(by), ["gy", "gx"])
    return joined.withColumn("score", -logsumexp(F.zip_with(F.zip_with("d2", "logdet", lambda a, b: -0.5 * (a + b + d * float(np.log(2 * np.pi)))), "place_w", lambda a, w: a + w))).drop("place_w")


def _batches(df: DataFrame, out: str, fn) -> DataFrame:
    """df with a double column that fn(pdf) gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = fn(pdf)
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {out} double")


def mahalanobis(df: DataFrame, models: Mapping[str, Mixture], key: str = "key", vec: str = "z", single: bool = False) -> DataFrame:
    """Least squared Mahalanobis distance to a full-covariance component; single computes in 32-bit floats."""
    shared = df.sparkSession.sparkContext.broadcast(dict(models))

    def score(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(pdf))
        for k, at in pdf.groupby(pdf[key].astype(str)).indices.items():
            m, z = shared.value[k], np.stack(pdf[vec].to_numpy()[at])
            if single:
                m = Mixture(m.means.astype(np.float32), m.covs.astype(np.float32), m.log_w)
                z = z.astype(np.float32)
            out[at] = m.distances(z)[0].min(1)
        return out

    return _batches(df, "distance", score)


def precision_diff(df: DataFrame, models: Mapping[str, Mixture], key: str = "key", vec: str = "z") -> DataFrame:
    """Largest relative difference between 32-bit and 64-bit distances."""
    a = mahalanobis(df, models, key, vec).withColumnRenamed("distance", "d64")
    b = mahalanobis(a, models, key, vec, single=True).withColumnRenamed("distance", "d32")
    return b.agg(F.max(F.abs(F.col("d32") - F.col("d64")) / F.greatest(F.abs("d64"), F.lit(1e-9))).alias("max_rel_diff"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix, without objects for its numbers."""
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks)])
    return flat.reshape(len(column), -1)


def least_distance(q: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """Distance of each row of q to its nearest row of b: 1 - cosine, or Euclidean."""
    if cosine:
        q, b = unit(q), unit(b)
    best = np.full(len(q), np.inf)
    for i in range(0, len(b), 2048):
        part = b[i : i + 2048]
        best = np.minimum(best, (1 - q @ part.T if cosine else (q**2).sum(1)[:, None] - 2 * q @ part.T + (part**2).sum(1)).min(1))
    return best if cosine else np.sqrt(np.maximum(best, 0))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def knn(queries: DataFrame, bank: DataFrame, row_id: str, cosine: bool = True, vec: str = "vec", tile_rows: int = 20_000) -> DataFrame:
    """Distance of each query row to its nearest bank row: 1 - cosine, or Euclidean. Exact; row_id names a query row.

    A bank within BROADCAST_BYTES is broadcast; a larger one is cut into the cells of pivots (see PivotBank)."""
    size, rows = bank.select(F.size(vec).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if size * 8 <= BROADCAST_BYTES:
        table = bank.select(F.col(vec).cast("array<double>").alias("v")).toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(_matrix(table.column("v")))
        return _batches(queries, "distance", lambda pdf: least_distance(np.stack(pdf[vec].to_numpy()).astype(float), shared.value, cosine))
    return PivotBank(bank, rows, cosine, vec, tile_rows).nearest(queries, row_id, vec)


def gaps(x: np.ndarray, pivots: np.ndarray, cosine: bool) -> np.ndarray:
    """Euclidean distance of each row (made a unit vector for cosines) to each pivot."""
    x = unit(x) if cosine else x
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), 0))


class PivotBank:
    """A bank dealt to its nearest pivots, so that most of it is ruled out for a query by the triangle inequality.

    Pivots are bank rows drawn by hash, two for each tile_rows rows and MOST at most; they are broadcast (MOST rows of D
    numbers). A cell is what is nearest to one pivot; the least and largest distance to it bound the cell: no row of it is
    nearer to a query at distance t than t - largest or least - t. A query looks at its own pivot's cell first, and then at
    those cells only whose bound is below what it found there. Cells of many rows or queries are met in parts of about
    tile_rows each; equal bank rows are one. Cosines are those of unit vectors, whose Euclidean distances bound them."""

    MOST = 1024

    def __init__(self, bank: DataFrame, rows: int, cosine: bool = True, vec: str = "vec", tile_rows: int = 20_000):
        self.cosine, self.tile_rows, self.spark = cosine, tile_rows, bank.sparkSession
        own = bank.select(F.col(vec).cast("array<double>").alias("b")).distinct()
        wanted = min(self.MOST, max(2, -(-2 * rows // tile_rows)))
        drawn = own.orderBy(F.xxhash64("b"), "b").limit(wanted).toArrow()  # MOST rows at most
        pivots = _matrix(drawn.column("b"))
        self.pivots = unit(pivots) if cosine else pivots
        shared = self.spark.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                d = gaps(np.stack(pdf["b"].to_numpy()), shared.value, cosine)
                pdf["cell"], pdf["gap"] = d.argmin(1), d.min(1)
                yield pdf

        self.cells = stored(own.mapInPandas(assign, "b array<double>, cell int, gap double"))
        n = len(self.pivots)
        self.least, self.most, self.held = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for r in self.cells.groupBy("cell").agg(F.min("gap").alias("a"), F.max("gap").alias("z"), F.count("*").alias("n")).collect():  # a row a pivot
            self.least[r["cell"]], self.most[r["cell"]], self.held[r["cell"]] = r["a"], r["z"], r["n"]

    def visits(self, queries: DataFrame, row_id: str, vec: str = "q", bound: str | None = None) -> DataFrame:
        """row_id, q and cell of what a query looks at: without bound its own cell, with it (a distance that the query has
        found) all other cells that may hold a nearer row."""
        shared = self.spark.sparkContext.broadcast((self.pivots, self.least, self.most, self.held))
        cosine = self.cosine

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, least, most, held = shared.value
            for pdf in batches:
                for i in range(0, len(pdf), 4096):
                    part = pdf.iloc[i : i + 4096]
                    d = gaps(np.stack(part[vec].to_numpy()), pivots, cosine)
                    own = np.where(held > 0, d, np.inf).argmin(1)
                    if bound is None:
                        at, cell = np.arange(len(part)), own
                    else:
                        u = part[bound].to_numpy(float)
                        u = np.sqrt(np.maximum(2 * u, 0)) if cosine else u
                        slack = 1e-6 * (1 + u)  # of the distances' own rounding
                        near = (np.maximum(d - most, least - d) < (u + slack)[:, None]) & (held > 0)
                        near[np.arange(len(part)), own] = False
                        at, cell = np.nonzero(near)
                    yield pd.DataFrame({row_id: part[row_id].to_numpy()[at], "q": part[vec].to_numpy()[at], "cell": cell.astype(np.int32)})

        kind = queries.schema[row_id].dataType.simpleString()
        return queries.mapInPandas(run, f"`{row_id}` {kind}, q array<double>, cell int")

    def meet(self, sent: DataFrame, row_id: str) -> DataFrame:
        """row_id and distance of the nearest of what is looked at."""
        cosine, kind = self.cosine, sent.schema[row_id].dataType.simpleString()
        sent = stored(sent)
        asked = np.zeros(len(self.held), np.int64)
        for r in sent.groupBy("cell").count().collect():  # a row a pivot
            asked[r["cell"]] = r["count"]
        tiles, parts = (F.array(*[F.lit(int(max(1, -(-n // self.tile_rows)))) for n in counts]) for counts in (self.held, asked))
        bank = self.cells.where(F.get(F.array(*[F.lit(bool(n)) for n in asked]), F.col("cell")))
        bank = bank.select("cell", "b", F.pmod(F.xxhash64("b"), F.get(tiles, F.col("cell"))).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1)).alias("part"))
        sent = sent.select(row_id, "q", "cell", F.pmod(F.xxhash64(row_id), F.get(parts, F.col("cell"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.get(tiles, F.col("cell")) - 1)).alias("tile"))

        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({row_id: [], "distance": []})
            return pd.DataFrame({row_id: left[row_id], "distance": least_distance(np.stack(left["q"].to_numpy()), np.stack(right["b"].to_numpy()), cosine)})

        groups = ("cell", "tile", "part")
        met = sent.groupBy(*groups).cogroup(bank.groupBy(*groups)).applyInPandas(lambda a, b: one(a, b), f"`{row_id}` {kind}, distance double")
        return met.groupBy(row_id).agg(F.min("distance").alias("distance"))

    def nearest(self, queries: DataFrame, row_id: str, vec: str = "vec") -> DataFrame:
        """queries with the distance to their nearest bank row."""
        own = queries.select(row_id, F.col(vec).cast("array<double>").alias("q"))
        first = stored(self.meet(self.visits(own, row_id), row_id))
        second = self.meet(self.visits(own.join(first, row_id), row_id, bound="distance"), row_id)
        least = first.unionByName(second).groupBy(row_id).agg(F.min("distance").alias("distance"))
        return queries.join(least, row_id)


def subspace_residual(df: DataFrame, mean: np.ndarray, comp: np.ndarray, vec: str = "vec") -> DataFrame:
    """Squared length of what a subspace leaves of each centred vector."""
    shared = df.sparkSession.sparkContext.broadcast((mean, comp))

    def score(pdf: pd.DataFrame) -> np.ndarray:
        mean, comp = shared.value
        z = np.stack(pdf[vec].to_numpy()).astype(float) - mean
        return np.maximum((z**2).sum(1) - ((z @ comp) ** 2).sum(1), 0)

    return _batches(df, "residual", score)


def ppca_residual(df: DataFrame, mean: np.ndarray, comp: np.ndarray, total: float, evals: np.ndarray, vec: str = "vec") -> DataFrame:
    """The residual over the mean variance of the directions outside; it is added to the distance inside the subspace."""
    rest = max(total - float(evals.sum()), 1e-12) / max(len(mean) - comp.shape[1], 1)
    return subspace_residual(df, mean, comp, vec).withColumn("residual", F.col("residual") / F.lit(rest))
