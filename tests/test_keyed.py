"""Models of many keys on executors against plain numpy, with parameters broadcast and dealt, and no key gathered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlane.operators import keyed, mixtures, models, scoring

KAPPA = 20.0


@pytest.fixture(scope="module")
def many(spark):
    """Fifty keys of different sizes, one of which holds a third of all rows, dealt over small groups."""
    rng = np.random.default_rng(7)
    data = {f"k{j}": rng.normal(size=(12 + j % 9 if j else 500, 5)) @ rng.normal(size=(5, 5)) + 1e4 * (j % 3) for j in range(50)}
    table = spark.createDataFrame([(k, i, v.tolist()) for k, x in data.items() for i, v in enumerate(x)], "name string, row_id int, vec array<double>").repartition(5)
    return data, table, keyed.deal(table, ["name"], group_bytes=8 * 5 * 64)


def test_rows_are_dealt_once_and_hot_keys_are_split(many):
    data, _, (rows, sizes) = many
    assert {r.key: r.n for r in sizes.collect()} == {k: len(x) for k, x in data.items()}
    assert rows.count() == sum(map(len, data.values()))
    assert rows.where("key = 'k0'").select("salt").distinct().count() == 8


def test_moments_and_pca_of_many_keys(many, monkeypatch):
    data, _, (rows, _) = many
    monkeypatch.setattr(keyed, "BLOCK", 7)  # a matrix lies in several rows
    cov = {r.key: r for r in keyed.covariances(rows).collect()}
    found = {r.key: r for r in keyed.pca(rows, 3).collect()}
    assert set(cov) == set(found) == set(data)
    for k, x in data.items():
        np.testing.assert_allclose(np.array(cov[k]["cov"]).reshape(5, 5), np.cov(x.T), rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(cov[k]["mean"], x.mean(0))
        values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
        np.testing.assert_allclose(found[k].evals, values[:3], rtol=1e-7)
        comp = np.array(found[k].comp).reshape(5, 3)
        np.testing.assert_allclose(comp.T @ comp, np.eye(3), atol=1e-9)
        np.testing.assert_allclose(np.var((x - x.mean(0)) @ comp, 0, ddof=1), values[:3], rtol=1e-7)
        assert found[k].total == pytest.approx(values.sum()) and found[k].n == len(x)
    share = {r.key: len(r.evals) for r in keyed.pca(rows, var=0.99).collect()}
    for k, x in data.items():
        values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
        assert share[k] == np.searchsorted(np.cumsum(values) / values.sum(), 0.99 - 1e-12) + 1


@pytest.mark.parametrize("small_bytes", [None, 0])
def test_projection_meets_models_by_key(many, small_bytes):
    data, _, (rows, _) = many
    table = keyed.stored(keyed.pca(rows, 2))
    comp = {r.key: np.array(r.comp).reshape(5, 2) for r in table.collect()}
    made = {(r.key, int(r.row_id)): r.vec for r in keyed.project(rows, table.where("key != 'k1'"), True, small_bytes).collect()}
    assert len(made) == sum(len(x) for k, x in data.items() if k != "k1")
    for k in ("k0", "k7", "k49"):
        z = (data[k] - data[k].mean(0)) @ comp[k]
        np.testing.assert_allclose([made[k, i] for i in range(len(z))], z / z.std(0, ddof=1), rtol=1e-6, atol=1e-9)


def test_range_finder_equals_svd(spark):
    rng = np.random.default_rng(9)
    data = {"a": rng.normal(size=(400, 60)) * np.geomspace(9, 0.1, 60), "b": rng.normal(size=(30, 60)), "c": np.outer(rng.normal(size=50), rng.normal(size=60))}
    table = spark.createDataFrame([(k, i, v.tolist()) for k, x in data.items() for i, v in enumerate(x)], "name string, row_id int, vec array<double>").repartition(4)
    made = {r.key: r for r in keyed.svd(*keyed.deal(table, ["name"]), 6).collect()}
    for k, x in data.items():
        s = np.linalg.svd(x)[1]
        np.testing.assert_allclose(np.sqrt(np.maximum(made[k].evals, 0)), s[:6], rtol=1e-6, atol=1e-6 * s[0])
        assert made[k].total == pytest.approx((x**2).sum())
    comp = np.array(made["a"].comp).reshape(60, 6)
    np.testing.assert_allclose(np.linalg.norm(data["a"] @ comp, axis=0), np.linalg.svd(data["a"])[1][:6], rtol=1e-6)


def test_seeding_needs_the_same_rounds_for_any_number_of_centres(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(m, 0.5, (60, 3)) for m in rng.normal(size=(20, 3)) * 8])
    table = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(x)], "name string, row_id int, vec array<double>").repartition(4)
    rows, sizes = keyed.deal(table, ["name"])
    passes, real = [], keyed.meet
    monkeypatch.setattr(keyed, "meet", lambda *a, **k: passes.append(1) or real(*a, **k))
    counts = {}
    for k in (3, 20):
        passes.clear()
        chosen = np.array(keyed.seeds(rows, keyed.stored(sizes.withColumn("k", F.lit(k)))).first().centres).reshape(-1, 3)
        counts[k] = len(passes)
        cost = mixtures.squared(x, mixtures.lloyd(x, chosen)).min(1).sum()
        one_by_one = np.mean([mixtures.squared(x, mixtures.lloyd(x, mixtures.spread_centres(x, k, np.random.default_rng(s)))).min(1).sum() for s in range(10)])
        assert len(chosen) == k and cost <= 1.05 * one_by_one
    assert counts[3] == counts[20]


@pytest.mark.parametrize("small_bytes", [None, 0])
def test_em_by_rounds_equals_em_in_one_group(spark, small_bytes):
    rng = np.random.default_rng(11)
    data = {f"k{j}": np.concatenate([rng.normal(m, 1, (70 + 30 * j, 4)) for m in (-3, 0, 4)]) for j in range(2)}
    table = spark.createDataFrame([(k, i, v.tolist()) for k, x in data.items() for i, v in enumerate(x)], "name string, row_id int, vec array<double>").repartition(4)
    rows, sizes = keyed.deal(table, ["name"], group_bytes=8 * 4 * 50)
    start = {k: x[[0, 100, 200]] for k, x in data.items()}
    prior = {k: x.var(0, ddof=1) for k, x in data.items()}
    centres = spark.createDataFrame([(k, c.ravel().tolist(), 4) for k, c in start.items()], "key string, centres array<double>, width int")
    priors = sizes.join(spark.createDataFrame([(k, p.tolist()) for k, p in prior.items()], "key string, evals array<double>"), "key")
    for cov in ("full", "tied"):
        made = keyed.em(rows, centres, priors, KAPPA, cov=cov, small_bytes=small_bytes, max_iter=4 if small_bytes == 0 else 30).toPandas().sort_values("component")
        for k, x in data.items():
            model, trace = mixtures.em(x, start[k], prior[k], KAPPA, cov=cov, max_iter=4 if small_bytes == 0 else 30)
            own = made[made["key"] == k]
            np.testing.assert_allclose(own["trace"].iloc[0], trace, rtol=1e-9)
            np.testing.assert_allclose(np.stack(own["centre"]), model.means, rtol=1e-7)
            np.testing.assert_allclose(np.stack(own["cov"]).reshape(3, 4, 4), model.covs, rtol=1e-7, atol=1e-9)
            np.testing.assert_allclose(own["log_w"], model.log_w, rtol=1e-8)
        if small_bytes == 0:
            break


def test_fit_without_a_bound_gives_the_same_kind_of_model(spark, monkeypatch):
    monkeypatch.setattr(keyed.seeds, "__defaults__", (0, 2))  # rounds of seeding
    rng = np.random.default_rng(12)
    data = {k: np.concatenate([rng.normal(m, 1, (100, 6)) for m in (-9, 0, 9)]) for k in ("a", "b")}
    table = spark.createDataFrame([(k, i, v.tolist()) for k, x in data.items() for i, v in enumerate(x)], "name string, row_id int, vec array<double>").repartition(4)
    unbounded, bounded = keyed.fit(table, ["name"], 3, 4, KAPPA), mixtures.fit_by_key(table, ["name"], 3, 4, KAPPA, n_init=3)
    assert unbounded.schema.simpleString() == bounded.schema.simpleString()
    one, other = ({r.key: r.fit for r in m.collect()} for m in (unbounded, bounded))
    assert one == pytest.approx(other, abs=1e-3)
    assert mixtures.score_by_key(table, unbounded, ["name"]).count() == 600


@pytest.mark.parametrize("small_bytes", [200 << 20, 0])
def test_models_are_broadcast_or_dealt(many, monkeypatch, small_bytes):
    data, table, (rows, _) = many
    monkeypatch.setattr(mixtures.with_models, "__defaults__", (*mixtures.with_models.__defaults__[:-1], small_bytes))
    pca = keyed.pca(rows, 2)
    made = {(r.name, r.row_id): r.residual for r in mixtures.residual_by_key(table, pca, ["name"], group_rows=50).collect()}
    comp = {r.key: np.array(r.comp).reshape(5, 2) for r in pca.collect()}
    assert len(made) == sum(map(len, data.values()))
    for k in ("k0", "k3"):
        x = data[k] - data[k].mean(0)
        np.testing.assert_allclose([made[k, i] for i in range(len(x))], ((x - x @ comp[k] @ comp[k].T) ** 2).sum(1), rtol=1e-5, atol=1e-6)


def test_wrappers_on_the_driver(many, monkeypatch):
    monkeypatch.setattr(keyed.seeds, "__defaults__", (0, 1))
    data, table, _ = many
    few = table.where("name in ('k0', 'k5')")
    assert np.allclose(models.moments(few, "name")["k5"].covariance(), np.cov(data["k5"].T))
    centres = models.kmeans_init(few, "name", 2, vec="vec")
    assert {k: c.shape for k, c in centres.items()} == {"k0": (2, 5), "k5": (2, 5)}
    assert models.kmeans_init(few.where("false"), "name", 2, vec="vec") == {}
    assert scoring.unit(np.ones((1, 4))).tolist() == [[0.5] * 4]
