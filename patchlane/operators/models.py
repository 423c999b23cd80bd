"""Models over tables of vectors: moments, PCA and shrunk Gaussian mixtures as numpy objects, and what is a table of numbers.

Fits run on executors (keyed.py, mixtures.py) and are tables there; the functions here that give dictionaries bring a few
models to the driver for code that wants them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from ..functions.shared import stored

RIDGE = 1e-2
TINY = 10 * np.finfo(float).eps


@dataclass
class Moments:
    """Number, mean and centred scatter of some vectors."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if n == 0:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)


def weighted_moments(x: np.ndarray, w: np.ndarray) -> Moments:
    n = w.sum()
    mean = w @ x / n if n > 0 else np.zeros(x.shape[1])
    d = x - mean
    return Moments(float(n), mean, (d * w[:, None]).T @ d)


def moments(df: DataFrame, key: str, vec: str = "vec") -> dict[str, Moments]:
    """Mean and scatter of the vectors of every key, on the driver: for a few keys. Tables of many: keyed.covariances."""
    from . import keyed

    made = keyed.covariances(keyed.deal(df.withColumn("row_id", F.xxhash64(vec)), [key], "row_id", vec)[0]).toArrow().to_pylist()
    return {r["key"]: Moments(r["n"], np.array(r["mean"]), np.array(r["cov"]).reshape(len(r["mean"]), -1) * max(r["n"] - 1, 1)) for r in made}


@dataclass
class PCA:
    mean: np.ndarray
    comp: np.ndarray  # D x d
    evals: np.ndarray
    total: float  # variance of all directions

    def project(self, x: np.ndarray, whiten: bool = False) -> np.ndarray:
        z = (x - self.mean) @ self.comp
        return z / np.sqrt(np.maximum(self.evals, 1e-12)) if whiten else z


def on_driver(table: DataFrame) -> dict[str, PCA]:
    return {r["key"]: PCA(np.array(r["mean"]), np.array(r["comp"]).reshape(len(r["mean"]), -1), np.array(r["evals"]), r["total"]) for r in table.toArrow().to_pylist()}


def fit_pca(df: DataFrame, key: str, d: int | None = None, skip: int = 0, var: float | None = None, vec: str = "vec", centre: bool = True) -> dict[str, PCA]:
    """Leading eigenpairs of every key's covariance (or, without centring, its Gram matrix), after the first `skip`: d of
    them, or the fewest whose cumulative share reaches var. On the driver, for a few keys; tables of many: keyed.pca."""
    from . import keyed

    return on_driver(keyed.pca(keyed.deal(df.withColumn("row_id", F.xxhash64(vec)), [key], "row_id", vec)[0], d, skip, var, centre))


def fit_svd(df: DataFrame, key: str, d: int, vec: str = "vec") -> dict[str, PCA]:
    """Truncated singular value decomposition, without centring, on the driver; tables: keyed.svd."""
    from . import keyed

    return on_driver(keyed.svd(*keyed.deal(df.withColumn("row_id", F.xxhash64(vec)), [key], "row_id", vec), d))


def project(df: DataFrame, key: str, models: Mapping[str, PCA], whiten: bool = False, vec: str = "vec", out: str = "z") -> DataFrame:
    """df with the projected vectors; models are broadcast (a few MB each)."""
    shared = df.sparkSession.sparkContext.broadcast(dict(models))
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            order, made = [np.zeros(0, int)], []
            for k, at in pdf.groupby(pdf[key].astype(str)).indices.items():
                order.append(at)
                made.extend(shared.value[k].project(np.stack(pdf[vec].to_numpy()[at]).astype(float), whiten))
            pdf = pdf.iloc[np.concatenate(order)].copy()
            pdf[out] = made
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.select(names).mapInPandas(run, f"{schema}, {out} array<double>")


def cap_components(n: int, d: int, k: int) -> int:
    """At most one component for each d + 10 vectors, and two at least."""
    return min(k, max(2, n // (d + 10)))


@dataclass
class Mixture:
    means: np.ndarray  # K x d
    covs: np.ndarray  # K x d x d
    log_w: np.ndarray
    made: tuple | None = None

    def distances(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared Mahalanobis distance to every component, and the log-determinants."""
        roots, logdet = self.roots()
        d2 = np.stack([(((z - m) @ r.T) ** 2).sum(1) for r, m in zip(roots, self.means, strict=True)], 1)
        return d2, logdet

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """The inverses of the covariances' lower factors, made once, and the log-determinants."""
        if self.made is None:
            chol = np.linalg.cholesky(self.covs)
            self.made = np.linalg.inv(chol), 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1)
        return self.made

    def log_joint(self, z: np.ndarray) -> np.ndarray:
        d2, logdet = self.distances(z)
        return -0.5 * (z.shape[1] * np.log(2 * np.pi) + logdet + d2) + self.log_w


def logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(1, keepdims=True)))[:, 0]


def m_step(parts: list[Moments], prior: np.ndarray, kappa: float, n: float, cov: str = "full", ridge: float = RIDGE) -> Mixture:
    """Parameters from the responsibility-weighted moments of each component.

    Covariances shrink toward diag(prior): (n_k C_k + kappa * prior) / (n_k + kappa) + ridge. kappa inf takes the prior
    alone. cov: full, diag, tied (the n_k-weighted mean for all) or oas (toward the mean variance,
    the share by oracle-approximating shrinkage)."""
    nk = np.array([p.n for p in parts]) + TINY
    d = len(prior)
    target = np.diag(prior)
    made = []
    for p, m in zip(parts, nk, strict=True):
        if np.isinf(kappa):
            c = target
        elif cov == "oas":
            s = p.scatter / m
            mu = np.trace(s) / d
            spread = ((s - mu * np.eye(d)) ** 2).sum()
            share = min(1.0, max(0.0, (np.trace(s) ** 2 + np.trace(s @ s)) / max(m, 1) / max(spread, 1e-12)))
            c = (1 - share) * s + share * mu * np.eye(d)
        else:
            c = (p.scatter + kappa * target) / (m + kappa)
        made.append(np.diag(np.diag(c)) if cov == "diag" else c)
    covs = np.stack(made)
    if cov == "tied":
        covs = np.repeat((covs * nk[:, None, None]).sum(0)[None] / nk.sum(), len(parts), 0)
    return Mixture(np.stack([p.mean for p in parts]), covs + ridge * np.eye(d), np.log(nk / n))


def kmeans_init(df: DataFrame, key: str, k: int, seed: int = 0, iterations: int = 100, vec: str = "z", row_id: str = "row_id") -> dict[str, np.ndarray]:
    """Centres of every key, on the driver (see keyed.kmeans); without rows there are none."""
    from . import keyed

    rows, sizes = keyed.deal(df, [key], row_id, vec)
    made = keyed.kmeans(rows, stored(sizes.withColumn("k", F.lit(k))), seed, iterations).toArrow().to_pylist()
    return {r["key"]: np.array(r["centres"]).reshape(-1, r["width"]) for r in made}


def assign(rows: DataFrame, centres: Mapping[str, np.ndarray]) -> DataFrame:
    """rows (key, z) with the nearest centre's number; ties take the first."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cluster"] = 0
            for k, at in pdf.groupby("key").indices.items():
                z = np.stack(pdf["z"].to_numpy()[at])
                c = shared.value[k]
                pdf.iloc[at, pdf.columns.get_loc("cluster")] = ((c**2).sum(1) - 2 * z @ c.T).argmin(1)
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, cluster int")


def fit_mixture(
    df: DataFrame, key: str, k: int, priors: Mapping[str, np.ndarray], kappa: float = 2000.0, max_iter: int = 30, tol: float = 1e-3, seed: int = 0, cov: str = "full", ridge: float = RIDGE, vec: str = "z", row_id: str = "row_id"
) -> tuple[dict[str, Mixture], dict[str, list[float]]]:
    """Mixtures of every key and their mean log-likelihoods by round, on the driver: for a few models of any number of rows.
    The fit itself is keyed.em, whose models are a table; for many bounded keys see mixtures.fit_by_key."""
    from . import keyed

    rows, sizes = keyed.deal(df, [key], row_id, vec)
    wanted = stored(sizes.withColumn("k", keyed.components(len(next(iter(priors.values()))), k)))
    given = df.sparkSession.createDataFrame([(m, [float(v) for v in p]) for m, p in priors.items()], "key string, evals array<double>")
    made = keyed.em(rows, keyed.kmeans(rows, wanted, seed), sizes.join(given, "key"), kappa, max_iter, tol, cov, ridge).toArrow().to_pandas()
    models, trace = {}, {}
    for m, own in made.sort_values("component").groupby("key"):
        means = np.stack(own["centre"].to_numpy())
        models[m] = Mixture(means, np.stack(own["cov"].to_numpy()).reshape(len(own), means.shape[1], -1), own["log_w"].to_numpy())
        trace[m] = list(own["trace"].iloc[0])
    return models, trace


def best_restart(models: Mapping[str, tuple[dict, dict]]) -> str:
    """Of restarts by name, the one of the highest last likelihood (ties: by name)."""
    return max(sorted(models), key=lambda name: sum(t[-1] for t in models[name][1].values() if t))


def relative_ridge(df: DataFrame, key: str, share: float, vec: str = "z") -> DataFrame:
    """A ridge for each key: share times the mean variance of the coordinates."""
    long = df.select(F.col(key).alias("key"), F.posexplode(vec).alias("i", "v"))
    return long.groupBy("key", "i").agg(F.var_samp("v").alias("var")).groupBy("key").agg((F.avg("var") * share).alias("ridge"))


def component_cap(df: DataFrame, keys: list[str], d: int, k: int) -> DataFrame:
    """The number of components of each key's model."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("k", F.least(F.lit(k), F.greatest(F.lit(2), F.floor(F.col("n") / (d + 10)).cast("int"))))


def diagonal_m_step(df: DataFrame, key: str, component: str, kappa: float, ridge: float = RIDGE, vec: str = "z", cov: str = "diag") -> DataFrame:
    """The M-step's diagonal for hard labels, one row a (key, component, coordinate): mean, variance, log weight.

    cov: diag, tied, or prior (kappa infinite). The prior is the key's own variance in each coordinate."""
    long = df.select(F.col(key).alias("key"), F.col(component).alias("component"), F.posexplode(vec).alias("i", "v"))
    prior = long.groupBy("key", "i").agg(F.var_samp("v").alias("prior"), F.count("*").alias("n"))
    parts = long.groupBy("key", "component", "i").agg(F.count("*").alias("nk"), F.avg("v").alias("mean"), F.var_pop("v").alias("c"))
    made = parts.join(prior, ["key", "i"]).withColumn("var", F.col("prior") if cov == "prior" else (F.col("nk") * F.col("c") + kappa * F.col("prior")) / (F.col("nk") + kappa))
    if cov == "tied":
        from pyspark.sql import Window

        w = Window.partitionBy("key", "i")
        made = made.withColumn("var", F.sum(F.col("var") * F.col("nk")).over(w) / F.sum("nk").over(w))
    return made.select("key", "component", "i", "mean", (F.col("var") + ridge).alias("var"), F.log(F.col("nk") / F.col("n")).alias("log_w"))


def state_mib(models: DataFrame) -> DataFrame:
    """Size of each model in MiB from its shape: D, d and K (mixtures), or numel (banks); four bytes a number."""
    d_, d, k = F.col("big_d"), F.col("d"), F.col("k")
    mixture = 4 * (d_ + d_ * d + k + k * d + k * d * (d + 1) / 2)
    return models.withColumn("mib", F.coalesce(4 * F.col("numel"), mixture) / (1 << 20))


def spatial_prior(resp: DataFrame, weights: DataFrame, height: int, width: int, lam: float, sigma: float = 2.0) -> DataFrame:
    """Blend of component weights with smoothed responsibilities by place (add-one smoothing over components).

    resp: gy, gx, component, r summed over references; weights: component, w."""
    from .grid import gaussian_smooth

    maps = resp.select(F.col("component").alias("image_id"), F.col("gy").alias("y"), F.col("gx").alias("x"), F.col("r").alias("value"))
    smooth = gaussian_smooth(maps, sigma, height, width, border="nearest")
    rows = smooth.select(F.col("y").alias("gy"), F.col("x").alias("gx"), F.col("image_id").alias("component"), (F.col("value") + 1).alias("v"))
    total = rows.groupBy("gy", "gx").agg(F.sum("v").alias("t"))
    joined = rows.join(total, ["gy", "gx"]).join(F.broadcast(weights), "component")
    return joined.select("gy", "gx", "component", ((1 - lam) * F.col("w") + lam * F.col("v") / F.col("t")).alias("prior"))


def loo_choice(maps: DataFrame, keys: tuple[str, ...] = ("dataset",), value: str = "value") -> DataFrame:
    """For each key, whether rotated fits flag fewer cells of held-out references than unrotated ones.

    maps: keys, views ('rot8' or 'none'), fold, held_out, value. A cell is flagged above the 95th percentile of the fold's
    other references."""
    limit = percentiles(maps.where(~F.col("held_out")), [*keys, "views", "fold"], value, [0.95]).select(*keys, "views", "fold", F.get("percentiles", 0).alias("t"))
    rate = maps.where("held_out").join(limit, [*keys, "views", "fold"]).groupBy(*keys, "views", "fold").agg(F.avg((F.col(value) > F.col("t")).cast("double")).alias("r"))
    wide = rate.groupBy(*keys).agg(F.avg(F.when(F.col("views") == "none", F.col("r"))).alias("fpr_none"), F.avg(F.when(F.col("views") == "rot8", F.col("r"))).alias("fpr_rot8"))
    return wide.withColumn("choice", F.when(F.col("fpr_rot8") < F.col("fpr_none"), "rot8").otherwise("none"))
