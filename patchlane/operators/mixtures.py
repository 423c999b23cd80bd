"""Mixtures and nearest neighbours for many model keys at once: a key's references are one bounded group.

A model is fitted on at most `limit` vectors of its key (a seeded draw, as cap_rows makes it), so a group never grows with
the data; keys are spread over the cluster, and models stay a table, one row for each key and component. Nothing of it
passes through the driver, but for models that are broadcast. For keys of any number of vectors, see keyed.fit, which works by
rounds and gives the same table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import bytes_of, stored
from .models import RIDGE, TINY, Mixture, cap_components, logsumexp, m_step, weighted_moments
from .projections import cap_rows

#: Models of at most so many bytes in all are broadcast.
SMALL_BYTES = 200 << 20
MODEL = "key string, variant string, mean array<double>, comp array<double>, evals array<double>, total double, component int, centre array<double>, cov array<double>, log_w double, fit double, rounds int, restart int"


def spread_centres(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further row is drawn with a chance in proportion to its squared distance from those drawn."""
    chosen = [int(rng.integers(len(z)))]
    near = ((z - z[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        mass = near.sum()
        chosen.append(int(rng.choice(len(z), p=near / mass) if mass > 0 else rng.integers(len(z))))
        near = np.minimum(near, ((z - z[chosen[-1]]) ** 2).sum(1))
    return z[chosen]


def squared(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((z**2).sum(1)[:, None] - 2 * z @ c.T + (c**2).sum(1), 0)


def lloyd(z: np.ndarray, centres: np.ndarray, iterations: int = 100, weights: np.ndarray | None = None) -> np.ndarray:
    """Lloyd steps until the squared shift is below 1e-8; an empty cluster keeps its centre."""
    w = np.ones(len(z)) if weights is None else weights
    for _ in range(iterations):
        label = squared(z, centres).argmin(1)
        n = np.bincount(label, w, minlength=len(centres))
        sums = np.stack([np.bincount(label, w * z[:, i], minlength=len(centres)) for i in range(z.shape[1])], 1)
        new = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], centres)
        shift = ((new - centres) ** 2).sum()
        centres = new
        if shift < 1e-8:
            break
    return centres


def shrunk(z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """The weighted covariance shrunk toward its mean variance by the share that minimises the expected squared error, and
    that share: the weights' squares give the error of the covariance's entries."""
    n, d = max(r.sum(), TINY), z.shape[1]
    x = z - r @ z / n
    s = (x * r[:, None]).T @ x / n
    mu = np.trace(s) / d
    gap = ((s - mu * np.eye(d)) ** 2).sum()
    error = (r**2 * ((x**2).sum(1) ** 2 - 2 * ((x @ s) * x).sum(1) + (s**2).sum())).sum() / n**2
    share = 1.0 if gap <= 0 else float(min(max(error, 0.0) / gap, 1.0))
    return (1 - share) * s + share * mu * np.eye(d), share


def em(z: np.ndarray, centres: np.ndarray, prior: np.ndarray, kappa: float, max_iter: int = 30, tol: float = 1e-3, cov: str = "full", ridge: float = RIDGE) -> tuple[Mixture, list[float]]:
    """A mixture from hard labels, and the mean log-likelihood of each round; rests when that changed by less than tol.

    cov as in m_step, and "lw": the weighted covariance shrunk toward its mean variance (see shrunk)."""

    def update(resp: np.ndarray) -> Mixture:
        made = m_step([weighted_moments(z, r) for r in resp.T], prior, kappa, len(z), "full" if cov == "lw" else cov, ridge)
        if cov == "lw":
            made = Mixture(made.means, np.stack([shrunk(z, r)[0] for r in resp.T]) + ridge * np.eye(z.shape[1]), made.log_w)
        return made

    model, trace = update(np.eye(len(centres))[squared(z, centres).argmin(1)]), []
    for _ in range(max_iter):
        joint = model.log_joint(z)
        norm = logsumexp(joint)
        trace.append(float(norm.mean()))
        model = update(np.exp(joint - norm[:, None]))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol:
            break
    return model, trace


def principal(x: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, leading directions (D x d), their variances and the variance in all."""
    mean = x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
    return mean, vectors[:, ::-1][:, :d], np.maximum(values[::-1][:d], 1e-12), float(values.sum())


def fit_by_key(
    refs: DataFrame, keys: Sequence[str], k: int, d: int, kappa: float = 2000.0, row_id: str = "row_id", vec: str = "vec", limit: int = 100_000, seed: int = 0,
    n_init: int = 1, max_iter: int = 30, tol: float = 1e-3, cov: str = "full", ridge: float = RIDGE, variant: str = "mixture",
) -> DataFrame:
    """A model of every key: PCA of its vectors to d directions, then a shrunk mixture of at most k components, the best of
    n_init restarts by last likelihood (ties: the first). A row for each key and component (see MODEL)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        mean, comp, evals, total = principal(x, d)
        z = (x - mean) @ comp
        count = min(cap_components(len(z), z.shape[1], k), len(z))
        tries = []
        for r in range(n_init):
            centres = lloyd(z, spread_centres(z, count, np.random.default_rng([seed, r])))
            tries.append((*em(z, centres, evals, kappa, max_iter, tol, cov, ridge), r))
        model, trace, r = max(tries, key=lambda t: (t[1][-1], -t[2]))
        return pd.DataFrame({
            "key": pdf["key"].iloc[0], "variant": variant, "mean": [mean] * count, "comp": [comp.ravel()] * count, "evals": [evals] * count, "total": total, "component": range(count),
            "centre": list(model.means), "cov": [c.ravel() for c in model.covs], "log_w": model.log_w, "fit": trace[-1], "rounds": len(trace), "restart": r,
        })

    rows = refs.select(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key"), F.col(row_id).cast("string").alias("row_id"), F.col(vec).cast("array<double>").alias("vec"))
    return cap_rows(rows, ["key"], limit, seed, "row_id").groupBy("key").applyInPandas(lambda pdf: fit(pdf), MODEL)


def with_models(rows: DataFrame, models: DataFrame, keys: Sequence[str], group_rows: int, each, out: str, kind: str = "double", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """rows with the column that each(rows, model rows) gives for rows of one key; rows without a model drop out.

    Models of at most small_bytes in all, by measure, are broadcast and rows stay where they are; otherwise rows are dealt by
    key into groups of about group_rows, and their model is sent to each."""
    own = rows.withColumn("__key", F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
    names, models = rows.columns, stored(models)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def made(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*names, out]})
        return left[names].assign(**{out: each(left, right)})

    if bytes_of(models) <= small_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(dict(tuple(models.toArrow().to_pandas().groupby("key"))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, left in pdf.groupby("__key", sort=False):
                    if k in shared.value:
                        yield made(left, shared.value[k])

        return own.mapInPandas(run, f"{schema}, {out} {kind}")
    sizes = own.groupBy("__key").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("__salts"))
    own = own.join(sizes, "__key").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), "__salts").cast("int")).drop("__salts")
    sent = models.join(sizes, F.col("key") == F.col("__key")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts", "__key")
    return own.groupBy("__key", "__salt").cogroup(sent.groupBy("key", "__salt")).applyInPandas(lambda left, right: made(left, right), f"{schema}, {out} {kind}")


def score_by_key(rows: DataFrame, models: DataFrame, keys: Sequence[str], vec: str = "vec", group_rows: int = 50_000, out: str = "distance", residual: bool = False, whiten: bool = False) -> DataFrame:
    """rows with the least squared Mahalanobis distance in their key's model. residual adds the squared length outside the
    subspace over the mean variance there; whiten takes the distance to the centres in whitened directions instead of the
    components' covariances. Rows without a model drop out."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        x, m = np.stack(left[vec].to_numpy()).astype(float), right.iloc[0]
        mean, evals = np.asarray(m["mean"]), np.asarray(m["evals"])
        comp, d = np.asarray(m["comp"]).reshape(len(mean), -1), len(evals)
        centres, z = np.stack(right["centre"].to_numpy()), (x - mean) @ comp
        if whiten:
            scale = np.sqrt(np.maximum(evals, 1e-12))
            made = squared(z / scale, centres / scale).min(1)
        else:
            made = Mixture(centres, np.stack([np.asarray(c).reshape(d, d) for c in right["cov"]]), right["log_w"].to_numpy()).distances(z)[0].min(1)
        if residual:
            rest = max(m["total"] - evals.sum(), 1e-12) / max(len(mean) - d, 1)
            made = made + np.maximum(((x - mean) ** 2).sum(1) - (z**2).sum(1), 0) / rest
        return made

    return with_models(rows, models, keys, group_rows, score, out)


def nearest_by_key(rows: DataFrame, refs: DataFrame, keys: Sequence[str], row_id: str = "row_id", vec: str = "vec", limit: int = 100_000, seed: int = 0, group_rows: int = 50_000, out: str = "distance", cosine: bool = True) -> DataFrame:
    """rows with the distance to the nearest of their key's references, 1 - cosine or Euclidean; at most `limit` of these."""
    bank = refs.select(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key"), F.col(row_id).cast("string").alias("row_id"), F.col(vec).cast("array<double>").alias("ref"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        q, b = np.stack(left[vec].to_numpy()).astype(float), np.stack(right["ref"].to_numpy())
        if cosine:
            q, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (q, b))
        best = np.full(len(q), np.inf)
        for i in range(0, len(q), 2048):
            for j in range(0, len(b), 2048):
                part = 1 - q[i : i + 2048] @ b[j : j + 2048].T if cosine else squared(q[i : i + 2048], b[j : j + 2048])
                best[i : i + 2048] = np.minimum(best[i : i + 2048], part.min(1))
        return best if cosine else np.sqrt(best)

    return with_models(rows, cap_rows(bank, ["key"], limit, seed, "row_id"), keys, group_rows, score, out)


def project_by_key(rows: DataFrame, models: DataFrame, keys: Sequence[str], vec: str = "vec", group_rows: int = 50_000, out: str = "z", whiten: bool = False) -> DataFrame:
    """rows with their vectors in the directions of their key's model (its first row's mean, comp and evals); whiten divides
    by the deviations."""

    def each(left: pd.DataFrame, right: pd.DataFrame) -> list:
        m = right.iloc[0]
        z = (np.stack(left[vec].to_numpy()).astype(float) - np.asarray(m["mean"])) @ np.asarray(m["comp"]).reshape(len(m["mean"]), -1)
        return list(z / np.sqrt(np.maximum(np.asarray(m["evals"]), 1e-12)) if whiten else z)

    return with_models(rows, models, keys, group_rows, each, out, "array<double>")


def residual_by_key(rows: DataFrame, models: DataFrame, keys: Sequence[str], vec: str = "vec", group_rows: int = 50_000, out: str = "residual", relative: bool = False) -> DataFrame:
    """rows with the squared length that their key's subspace leaves of the centred vector; relative: over the mean variance
    of the directions outside."""

    def each(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        m = right.iloc[0]
        x, evals = np.stack(left[vec].to_numpy()).astype(float) - np.asarray(m["mean"]), np.asarray(m["evals"])
        rest = np.maximum((x**2).sum(1) - ((x @ np.asarray(m["comp"]).reshape(x.shape[1], -1)) ** 2).sum(1), 0)
        return rest / (max(m["total"] - evals.sum(), 1e-12) / max(x.shape[1] - len(evals), 1)) if relative else rest

    return with_models(rows, models, keys, group_rows, each, out)
