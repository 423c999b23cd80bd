"""Nearest neighbours in a bank beyond a broadcast: exact, and most cells are never looked at."""

import numpy as np
import pytest

from patchlane.operators import scoring


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 6)) * 10
    bank = np.concatenate([middles[k] + rng.normal(size=(300 if k == 0 else 40, 6)) for k in range(12)])  # one crowded place
    bank = np.concatenate([bank, np.repeat(bank[:1], 60, 0)])
    asked = np.concatenate([middles[rng.integers(12, size=60)] + rng.normal(size=(60, 6)), rng.normal(size=(10, 6)) * 30, bank[:3]])
    frame = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>").repartition(3)
    return bank, asked, frame(bank, "i"), frame(asked, "row_id")


@pytest.mark.parametrize("cosine", [True, False])
def test_cells_of_pivots_are_exact_and_skip_most(clustered, monkeypatch, cosine):
    bank, asked, b, q = clustered
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 0)
    made = {r.row_id: r.distance for r in scoring.knn(q, b, "row_id", cosine, tile_rows=64).collect()}
    if cosine:
        x, y = scoring.unit(asked), scoring.unit(bank)
        true = 1 - (x @ y.T).max(1)
    else:
        true = np.sqrt(((asked[:, None] - bank[None]) ** 2).sum(2)).min(1)
    assert set(made) == set(range(len(asked)))
    np.testing.assert_allclose([made[i] for i in range(len(asked))], true, atol=1e-6)

    index = scoring.PivotBank(b, len(bank), cosine, tile_rows=64)
    own = q.selectExpr("row_id", "vec as q")
    first = index.visits(own, "row_id")
    assert first.count() == len(asked) and (index.held > 0).sum() > 5
    found = index.meet(first, "row_id")
    later = index.visits(own.join(found, "row_id"), "row_id", bound="distance").count()
    assert (len(asked) + later) / (len(asked) * (index.held > 0).sum()) < 0.5
    assert int(index.held.sum()) == len(np.unique(bank, axis=0))
