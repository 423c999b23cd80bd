"""Models of many keys over any number of vectors, fitted on executors: moments, PCA, truncated SVD, k-means and mixtures.

A fit is a few passes over the vectors. They are dealt once, by key and salt, so that a task holds few keys and a large key
stands in many tasks. A pass gives sums by key: each task adds up what its rows contribute (matrices that are additive, taken
about a point of the key that the pass before fixed, so no digits are lost), the sums are cut into blocks of BLOCK numbers,
and the blocks meet by (key, part, block), streamed. Parameters are tables of a few rows a key. Where they come to
SMALL_BYTES at most, by measure, they are broadcast to the pass; beyond that rows and parameters meet by (key, salt). The
driver sees how many keys still move and no matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hash_draw
from ..functions.shared import bytes_of, dropped, stored
from .mixtures import MODEL, lloyd, squared
from .models import RIDGE, Mixture, Moments, logsumexp, m_step

#: Numbers of a sum in one row.
BLOCK = 8192
#: Vectors of a (key, salt), in bytes.
GROUP_BYTES = 64 << 20
#: Parameters of at most so many bytes are broadcast.
SMALL_BYTES = 200 << 20
#: Sums of many keys that a task holds before it sends them.
HELD_BYTES = 256 << 20
PCA_TABLE = "key string, n double, mean array<double>, comp array<double>, evals array<double>, total double"
#: Rounds of seeding; each draws twice the wanted centres.
SEED_ROUNDS = 5


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def no_rows(schema: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})


def deal(df: DataFrame, keys: Sequence[str], row_id: str = "row_id", vec: str = "vec", group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """The vectors as a table key, salt, row_id, vec, clustered by key and salt; and the keys' n, width and salts."""
    rows = df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key"), F.col(row_id).cast("string").alias("row_id"), F.col(vec).cast("array<double>").alias("vec"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"))
    sizes = stored(sizes.withColumn("salts", F.ceil(F.col("n") * F.col("width") * 8 / group_bytes).cast("int")))
    salted = rows.join(sizes.select("key", "salts"), "key").withColumn("salt", F.pmod(F.xxhash64("row_id", "vec"), F.greatest("salts", F.lit(1))).cast("int"))
    return stored(salted.select("key", "salt", "row_id", "vec").repartition("key", "salt").sortWithinPartitions("key", "salt")), sizes


def meet(rows: DataFrame, table: DataFrame | None, each: Callable[[str, pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str, small_bytes: int | None = None, gather: Callable = iter) -> DataFrame:
    """What each(key, rows, parameters) gives for the dealt rows of a key (not all of them at once), gathered by task. Without
    a table all keys are met, with one those that it holds. The table is read more than once."""
    limit = SMALL_BYTES if small_bytes is None else small_bytes
    if table is not None and bytes_of(table) > limit:
        dealt = rows.select(F.col("key").alias("__key"), F.col("salt").alias("__salt")).distinct()
        sent = table.join(dealt, F.col("key") == F.col("__key")).select(*table.columns, F.col("__salt").alias("salt"))

        def grouped(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return no_rows(schema)
            return each(left["key"].iloc[0], left, right.drop(columns="salt"))

        met = rows.groupBy("key", "salt").cogroup(sent.groupBy("key", "salt")).applyInPandas(lambda a, b: grouped(a, b), schema)
        return met if gather is iter else met.mapInPandas(gather, schema)
    # Within the limit: rows of parameters that every task may hold.
    known = None if table is None else dict(tuple(table.toArrow().to_pandas().groupby("key")))
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, own in pdf.groupby("key", sort=False):
                if shared.value is None or k in shared.value:
                    yield each(k, own, None if shared.value is None else shared.value[k])

    return rows.mapInPandas(lambda batches: gather(run(batches)), schema)


SUMS = "key string, part int, block int, values array<double>"


def totals(rows: DataFrame, table: DataFrame | None, contribution: Callable[[np.ndarray, pd.DataFrame | None], list[np.ndarray]], small_bytes: int | None = None) -> DataFrame:
    """key, part, block, values: sums over each key's rows of the vectors (a part each) that contribution(x, parameters) gives.

    What a task's rows of a key contribute is added up before it is sent."""
    names = ["key", "part", "block", "values"]

    def each(k: str, own: pd.DataFrame, p: pd.DataFrame | None) -> pd.DataFrame:
        made = [(k, i, j, v.ravel()[j * BLOCK : (j + 1) * BLOCK]) for i, v in enumerate(contribution(matrix(own["vec"]), p)) for j in range(-(-v.size // BLOCK))]
        return pd.DataFrame(made, columns=names)

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for pdf in frames:
            for *name, v in pdf.itertuples(index=False):
                before = held.get(tuple(name))
                held[tuple(name)] = np.array(v) if before is None else before + v
                size += 8 * len(v) if before is None else 0
            if size > HELD_BYTES:
                yield pd.DataFrame([(*name, v) for name, v in held.items()], columns=names)
                held, size = {}, 0
        if held:
            yield pd.DataFrame([(*name, v) for name, v in held.items()], columns=names)

    return summed(meet(rows, table, each, SUMS, small_bytes, gather))


def summed(partials: DataFrame) -> DataFrame:
    """Partial sums of equal key, part and block added up, one at a time as they come in order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]], pa.int32()), pa.array([name[2]], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["key", "part", "block", "values"])

        for batch in batches:
            flat, ends = batch.column(3).flatten().to_numpy(), np.r_[0, np.cumsum(batch.column(3).value_lengths().to_numpy())]
            for i, own in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                v = flat[ends[i] : ends[i + 1]]
                if own == name:
                    total = total + v
                else:
                    if name is not None:
                        yield row()
                    name, total = own, v
        if name is not None:
            yield row()

    return partials.repartition("key", "part", "block").sortWithinPartitions("key", "part", "block").mapInArrow(add, SUMS)


def parts_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    """The parts of one key's sums, whole again."""
    pdf = pdf.sort_values(["part", "block"], kind="stable")
    return [np.concatenate(own["values"].to_numpy()) for _, own in pdf.groupby("part")]


def updated(table: DataFrame, sums: DataFrame, each: Callable[[pd.DataFrame, list[np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """What each(parameters, sums) gives for each key; a group is a key's parameters and its sums."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return each(left, parts_of(right)) if len(left) and len(right) else no_rows(schema)

    return table.groupBy("key").cogroup(sums.groupBy("key")).applyInPandas(lambda a, b: one(a, b), schema)


# Moments, PCA, SVD


def means(rows: DataFrame) -> DataFrame:
    """key, n and mean."""
    sums = totals(rows, None, lambda x, _: [np.r_[len(x), x.sum(0)]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        (s,) = parts_of(pdf)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": s[0], "mean": [s[1:] / s[0]]})

    return stored(sums.groupBy("key").applyInPandas(lambda pdf: one(pdf), "key string, n double, mean array<double>"))


def covariances(rows: DataFrame, centre: bool = True) -> DataFrame:
    """key, n, mean and cov (D x D) of each key: the sample covariance, or without centring the sum of squares."""
    about = means(rows)

    def contribution(x: np.ndarray, p: pd.DataFrame) -> list[np.ndarray]:
        d = x - np.asarray(p["mean"].iloc[0]) if centre else x
        return [d.T @ d]

    def one(p: pd.DataFrame, sums: list[np.ndarray]) -> pd.DataFrame:
        return p.assign(cov=[sums[0] / max(p["n"].iloc[0] - 1, 1) if centre else sums[0]])

    return updated(about, totals(rows, about, contribution), one, "key string, n double, mean array<double>, cov array<double>")


def pca(rows: DataFrame, d: int | None = None, skip: int = 0, var: float | None = None, centre: bool = True) -> DataFrame:
    """The leading eigenpairs of each key's covariance (PCA_TABLE; comp is D x d), after the first `skip`: d of them, or the
    fewest whose cumulative share reaches var. total is the variance of all directions. A key's matrix is one task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, n, mean, cov in zip(pdf["key"], pdf["n"], pdf["mean"], pdf["cov"], strict=True):
                values, vectors = np.linalg.eigh(np.asarray(cov).reshape(len(mean), -1))
                values, vectors = values[::-1], vectors[:, ::-1]
                count = d if d is not None else len(values)
                if var is not None:
                    count = int(np.searchsorted(np.cumsum(values) / values.sum(), var - 1e-12) + 1)
                out.append((k, n, mean if centre else np.zeros(len(mean)), vectors[:, skip : skip + count].ravel(), values[skip : skip + count], values.sum()))
            yield pd.DataFrame(out, columns=["key", "n", "mean", "comp", "evals", "total"])

    return covariances(rows, centre).mapInPandas(run, PCA_TABLE)


#: Blocks of directions that the range finder keeps before it goes on from the best of them.
KEPT_BLOCKS = 4


def widened(basis: np.ndarray, image: np.ndarray, d: int, size: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A step of the range finder: from an orthonormal basis and its image under the Gram matrix, the basis (cut down to its
    best directions once it is large) and its image, the leading d Ritz values, and the block of new directions to try:
    what the image of the best ones has outside the basis. No block means that the leading d rest."""
    h = basis.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1][:size], turn[:, ::-1][:, :size]
    x, gx = basis @ turn, image @ turn
    rest = gx - x * values
    scale = max(abs(values[0]), 1e-300)
    if basis.shape[1] > (KEPT_BLOCKS - 1) * size:
        basis, image = x, gx
    if (np.linalg.norm(rest[:, :d], axis=0) <= tol * scale).all():
        return x, gx, values[:d], np.zeros((len(x), 0))
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    u, norms, _ = np.linalg.svd(rest, full_matrices=False)
    block = u[:, norms > 1e-14 * scale][:, : len(x) - basis.shape[1]]
    block = block - basis @ (basis.T @ block)
    return basis, image, values[:d], np.linalg.qr(block)[0]


def svd(rows: DataFrame, sizes: DataFrame, d: int, oversample: int = 10, passes: int = 50, tol: float = 1e-9, seed: int = 0) -> DataFrame:
    """The leading d right singular vectors of each key's matrix of rows, without centring (PCA_TABLE; evals are the squared
    singular values), by a randomised range finder: a random D x (d + oversample) block goes through the rows' Gram matrix,
    which is never formed, and each pass adds what its image has outside the directions so far, until the leading ones'
    images stay within them. A key's state is at most 2 KEPT_BLOCKS such blocks."""
    schema = "key string, n double, width int, basis array<double>, image array<double>, block array<double>, ritz array<double>, total double, moves boolean"
    size = d + oversample

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [np.linalg.qr(np.random.default_rng(seed).normal(size=(w, min(w, size))))[0].ravel() for w in pdf["width"]]
            nothing = [np.zeros(0)] * len(pdf)
            yield pd.DataFrame({"key": pdf["key"], "n": pdf["n"].astype(float), "width": pdf["width"], "basis": nothing, "image": nothing, "block": made, "ritz": nothing, "total": 0.0, "moves": True})

    def contribution(x: np.ndarray, p: pd.DataFrame) -> list[np.ndarray]:
        return [x.T @ (x @ np.asarray(p["block"].iloc[0]).reshape(x.shape[1], -1)), np.array([(x**2).sum()])]

    def one(p: pd.DataFrame, sums: list[np.ndarray]) -> pd.DataFrame:
        basis, image, block = (np.asarray(p[c].iloc[0]).reshape(p["width"].iloc[0], -1) for c in ("basis", "image", "block"))
        basis, image, ritz, block = widened(np.hstack([basis, block]), np.hstack([image, sums[0].reshape(block.shape)]), d, size, tol)
        moves = block.shape[1] > 0
        return p.assign(basis=[basis.ravel()], image=[image.ravel()], block=[block.ravel()], ritz=[ritz], total=sums[1][0], moves=moves)

    table, final = stored(sizes.select("key", "n", "width").mapInPandas(start, schema)), None
    for left in range(passes - 1, -1, -1):
        made = stored(updated(table, totals(rows, table, contribution), one, schema))
        done = made if not left else made.where("not moves")
        final = done if final is None else final.unionByName(done)
        table = made.where("moves")
        if table.isEmpty():
            break

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            comp = []
            for b, i, w, r in zip(pdf["basis"], pdf["image"], pdf["width"], pdf["ritz"], strict=True):
                b, i = np.asarray(b).reshape(w, -1), np.asarray(i).reshape(w, -1)
                comp.append((b @ np.linalg.eigh(b.T @ i + i.T @ b)[1][:, ::-1][:, : len(r)]).ravel())
            yield pd.DataFrame({"key": pdf["key"], "n": pdf["n"], "mean": [np.zeros(w) for w in pdf["width"]], "comp": comp, "evals": pdf["ritz"], "total": pdf["total"]})

    return final.mapInPandas(finish, PCA_TABLE)


def project(rows: DataFrame, table: DataFrame, whiten: bool = False, small_bytes: int | None = None) -> DataFrame:
    """The dealt rows with their vectors in their key's directions; whiten divides by the deviations. Keys without a model
    drop out."""

    def each(k: str, own: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        mean = np.asarray(p["mean"].iloc[0])
        z = (matrix(own["vec"]) - mean) @ np.asarray(p["comp"].iloc[0]).reshape(len(mean), -1)
        z = z / np.sqrt(np.maximum(np.asarray(p["evals"].iloc[0]), 1e-12)) if whiten else z
        return own[["key", "salt", "row_id"]].assign(vec=list(z))

    return meet(rows, table, each, "key string, salt int, row_id string, vec array<double>", small_bytes)


# Centres


def seeds(rows: DataFrame, sizes: DataFrame, seed: int = 0, rounds: int = SEED_ROUNDS) -> DataFrame:
    """key and centres (k x d) of every key (sizes: key, k), by oversampling: each round draws 2 k rows with a chance in
    proportion to their squared distance from what is drawn (the least of -ln(u) / distance, u from a hash), so the number of
    passes does not depend on k. Drawn rows weigh as many rows as are nearest to them; k of them are chosen one by one like
    that, with their weights, and moved to the means of their share. A group is the drawn rows of a key: 2 k rounds + 1."""
    drawn, most = None, 2 * (sizes.agg(F.max("k")).first()[0] or 1)
    for j in range(rounds + 1):
        table = None if drawn is None else stored(drawn.groupBy("key").agg(F.flatten(F.collect_list("vec")).alias("centres"), F.first(F.size("vec")).alias("width")))

        def far(k: str, own: pd.DataFrame, p: pd.DataFrame | None) -> pd.DataFrame:
            x = matrix(own["vec"])
            near = np.ones(len(x)) if p is None else squared(x, np.asarray(p["centres"].iloc[0]).reshape(-1, p["width"].iloc[0])).min(1)
            own = own.assign(race=-np.log(own["u"].to_numpy()) / np.where(near > 0, near, 1))[near > 0]
            return own.sort_values(["race", "row_id"])[["key", "row_id", "vec", "race"]].head(most)  # no more of them can win

        u = (hash_draw(F.lit(seed), F.lit(j), F.col("row_id")) + 1) / F.lit(4294967297.0)
        found = meet(rows.withColumn("u", u), table, far, "key string, row_id string, vec array<double>, race double")
        order = Window.partitionBy("key").orderBy("race", "row_id")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(sizes.select("key", "k"), "key")
        found = found.where(F.col("place") <= (F.lit(1) if j == 0 else 2 * F.col("k"))).select("key", "row_id", "vec")
        before = drawn
        drawn = stored(found if drawn is None else drawn.unionByName(found))
        if before is not None:
            dropped(before)
    table = stored(drawn.orderBy("key", "row_id").groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "vec"))), lambda s: s["vec"])).alias("centres"), F.first(F.size("vec")).alias("width")).join(sizes.select("key", "k"), "key"))

    def shares(x: np.ndarray, p: pd.DataFrame) -> list[np.ndarray]:
        c = np.asarray(p["centres"].iloc[0]).reshape(-1, x.shape[1])
        return [np.bincount(squared(x, c).argmin(1), minlength=len(c)).astype(float)]

    def choose(p: pd.DataFrame, sums: list[np.ndarray]) -> pd.DataFrame:
        c, w, k = np.asarray(p["centres"].iloc[0]).reshape(-1, p["width"].iloc[0]), sums[0], int(p["k"].iloc[0])
        tries = []
        for r in range(5):
            rng = np.random.default_rng([seed, r])
            chosen = [int(rng.choice(len(c), p=w / w.sum()))]
            near = squared(c, c[chosen]).min(1)
            while len(chosen) < k:
                mass = w * near
                chosen.append(int(rng.choice(len(c), p=mass / mass.sum())) if mass.sum() > 0 else int(rng.integers(len(c))))
                near = np.minimum(near, squared(c, c[chosen[-1:]])[:, 0])
            centres = lloyd(c, c[chosen], weights=w)
            tries.append(((w * squared(c, centres).min(1)).sum(), r, centres))
        centres = min(tries, key=lambda t: t[:2])[2]
        return pd.DataFrame({"key": [p["key"].iloc[0]], "centres": [centres.ravel()], "width": centres.shape[1], "cost": 0.0, "moves": True})

    return updated(table, totals(rows, table, shares), choose, CENTRES)


CENTRES = "key string, centres array<double>, width int, cost double, moves boolean"


def kmeans(rows: DataFrame, sizes: DataFrame, seed: int = 0, iterations: int = 100) -> DataFrame:
    """Centres of every key (CENTRES): seeds, then Lloyd steps until the squared shift is below 1e-8; an empty cluster keeps
    its centre. cost is the sum of squared distances before the last step. sizes: key, k."""

    def contribution(x: np.ndarray, p: pd.DataFrame) -> list[np.ndarray]:
        c = np.asarray(p["centres"].iloc[0]).reshape(-1, x.shape[1])
        d = squared(x, c)
        label = d.argmin(1)
        sums = np.stack([np.bincount(label, v, minlength=len(c)) for v in (np.ones(len(x)), *x.T)], 1)
        return [np.r_[sums.ravel(), d.min(1).sum()]]

    def one(p: pd.DataFrame, sums: list[np.ndarray]) -> pd.DataFrame:
        c = np.asarray(p["centres"].iloc[0]).reshape(-1, p["width"].iloc[0])
        s = sums[0][:-1].reshape(len(c), -1)
        new = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), c)
        return p.assign(centres=[new.ravel()], cost=sums[0][-1], moves=((new - c) ** 2).sum() >= 1e-8)

    table, final = stored(seeds(rows, sizes, seed)), None
    for left in range(iterations - 1, -1, -1):
        made = stored(updated(table, totals(rows, table, contribution), one, CENTRES))
        done = made if not left else made.where("not moves")
        final = done if final is None else final.unionByName(done)
        table = made.where("moves")
        if table.isEmpty():
            break
    return table if final is None else final


# Mixtures


def components(d: int, k: int) -> Column:
    """The number of components of a key with n vectors: one for each d + 10 of them, two at least, k and n at most."""
    return F.least(F.lit(k), F.greatest(F.lit(2), F.floor(F.col("n") / (d + 10)).cast("int")), F.col("n").cast("int"))


STATE = "key string, component int, centre array<double>, cov array<double>, log_w double, prior array<double>, n double, trace array<double>, moves boolean"


def em(rows: DataFrame, centres: DataFrame, priors: DataFrame, kappa: float = 2000.0, max_iter: int = 30, tol: float = 1e-3, cov: str = "full", ridge: float = RIDGE, small_bytes: int | None = None) -> DataFrame:
    """A mixture of every key by EM from the hard labels of its centres, a row for each component (STATE): a round takes
    responsibilities and likelihood from the parameters and updates these; a key whose mean likelihood changed by less than
    tol rests and its rows are read no more. priors: key, n, evals."""

    def moments(x: np.ndarray, r: np.ndarray, about: np.ndarray) -> list[np.ndarray]:
        out = []
        for w, m in zip(r.T, about, strict=True):
            d = x - m
            out.append(np.r_[w.sum(), w @ d, ((d * w[:, None]).T @ d).ravel()])
        return out

    def parts(sums: list[np.ndarray], about: np.ndarray) -> list[Moments]:
        out, d = [], about.shape[1]
        for s, m in zip(sums, about, strict=False):
            shift = s[1 : d + 1] / s[0] if s[0] > 0 else np.zeros(d)
            out.append(Moments(s[0], m + shift, s[d + 1 :].reshape(d, d) - s[0] * np.outer(shift, shift)))
        return out

    def rows_of(key: str, made: Mixture, prior: np.ndarray, n: float, trace: list[float]) -> pd.DataFrame:
        k = len(made.means)
        rest = len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol
        return pd.DataFrame({"key": key, "component": range(k), "centre": list(made.means), "cov": [c.ravel() for c in made.covs], "log_w": made.log_w, "prior": [prior] * k, "n": n, "trace": [np.array(trace, float)] * k, "moves": not rest})

    def hard(x: np.ndarray, p: pd.DataFrame) -> list[np.ndarray]:
        c = np.asarray(p["centres"].iloc[0]).reshape(-1, x.shape[1])
        return moments(x, np.eye(len(c))[squared(x, c).argmin(1)], c)

    def first(p: pd.DataFrame, sums: list[np.ndarray]) -> pd.DataFrame:
        c, prior, n = np.asarray(p["centres"].iloc[0]).reshape(-1, p["width"].iloc[0]), np.asarray(p["evals"].iloc[0]), float(p["n"].iloc[0])
        return rows_of(p["key"].iloc[0], m_step(parts(sums, c), prior, kappa, n, cov, ridge), prior, n, [])

    def mixture(p: pd.DataFrame) -> Mixture:
        p = p.sort_values("component")
        m = matrix(p["centre"])
        return Mixture(m, matrix(p["cov"]).reshape(len(m), m.shape[1], -1), p["log_w"].to_numpy(float))

    def expect(x: np.ndarray, p: pd.DataFrame) -> list[np.ndarray]:
        model = mixture(p)
        joint = model.log_joint(x)
        norm = logsumexp(joint)
        return [*moments(x, np.exp(joint - norm[:, None]), model.means), np.array([norm.sum()])]

    def maximise(p: pd.DataFrame, sums: list[np.ndarray]) -> pd.DataFrame:
        prior, n = np.asarray(p["prior"].iloc[0]), float(p["n"].iloc[0])
        made = m_step(parts(sums[:-1], mixture(p).means), prior, kappa, n, cov, ridge)
        return rows_of(p["key"].iloc[0], made, prior, n, [*p["trace"].iloc[0], sums[-1][0] / n])

    start = stored(centres.select("key", "centres", "width").join(priors.select("key", "n", "evals"), "key"))
    table, final = stored(updated(start, totals(rows, start, hard, small_bytes), first, STATE)), None
    for left in range(max_iter - 1, -1, -1):
        made = stored(updated(table, totals(rows, table, expect, small_bytes), maximise, STATE))
        done = made if not left else made.where("not moves")
        final = done if final is None else final.unionByName(done)
        table = made.where("moves")
        if table.isEmpty():
            break
    return table if final is None else final


def fit(refs: DataFrame, keys: Sequence[str], k: int, d: int, kappa: float = 2000.0, row_id: str = "row_id", vec: str = "vec", seed: int = 0, max_iter: int = 30, tol: float = 1e-3, cov: str = "full", ridge: float = RIDGE, variant: str = "mixture", small_bytes: int | None = None) -> DataFrame:
    """A model of every key over all of its vectors: PCA to d directions, k-means and EM. The table is that of
    mixtures.fit_by_key, which fits bounded keys in one group each; this one has no bound and works by rounds."""
    rows, sizes = deal(refs, keys, row_id, vec)
    table = stored(pca(rows, d))
    z = stored(project(rows, table, small_bytes=small_bytes))
    wanted = stored(sizes.withColumn("k", components(d, k)))
    state = em(z, kmeans(z, wanted, seed), table, kappa, max_iter, tol, cov, ridge, small_bytes)
    made = state.withColumns({"fit": F.element_at("trace", -1), "rounds": F.size("trace"), "variant": F.lit(variant), "restart": F.lit(0)})
    return made.join(table.select("key", "mean", "comp", "evals", "total"), "key").selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in MODEL.split(", ")])
