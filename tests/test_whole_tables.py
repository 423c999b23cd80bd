"""Queries over id subsets or with few iterations once: whole tables equal to brute force, and the rounds they ask for."""

import inspect
import math
from collections import Counter

import numpy as np
import pytest

from patchlane.operators import mixtures, stats
from patchlane.plans import all_queries

H, W, IMAGES = 50, 11, 7
IDS = (1, 2, 3, 5, 8, 21, 30)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(3)
    items = [(i, float(rng.integers(1, 51)), float(rng.integers(0, 11)) / 100, float(rng.integers(1, 10**6)), "R") for i in IDS for _ in range(200)]
    spark.createDataFrame(items, "l_suppkey long, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    vectors = [(k, k // 16 % 3, rng.normal(size=64).tolist()) for k in range(10 * 16)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    grids = {i: np.zeros((H, W)) for i in IDS}
    for i, y, x, v, _ in items:
        grids[i][int(y) - 1, round(x * 100)] += v
    return str(path), grids


def rows(spark, folder, name):
    return all_queries()[0][name](spark, folder[0]).collect()


def taps(y, x):
    """Source cells and weights of a place, unbounded."""
    y0, x0 = math.floor(y), math.floor(x)
    return [(y0 + a, x0 + b, w) for a in (0, 1) for b in (0, 1) if (w := ((y - y0) if a else 1 - (y - y0)) * ((x - x0) if b else 1 - (x - x0))) > 0]


def turned(y, x, angle):
    c, s, u, v = math.cos(math.radians(angle)), math.sin(math.radians(angle)), x - W / 2, y - H / 2
    return taps(round(s * u + c * v + H / 2, 9), round(c * u - s * v + W / 2, 9))


def mirrored(i, n):
    m = i % (2 * n - 2)
    return m if m < n else 2 * n - 2 - m


def test_rotated_views_of_every_image(spark, folder):
    got = {(r.image_id, r.angle, r.y, r.x): r.value for r in rows(spark, folder, "grd4_rotate_views")}
    assert len(got) == IMAGES * 8 * H * W
    for (i, angle, y, x), value in got.items():
        assert value == pytest.approx(sum(w * folder[1][i][mirrored(a, H), mirrored(b, W)] for a, b, w in turned(y, x, angle)), abs=1e-2)


@pytest.mark.parametrize("name", ["grd8_upsample_corner", "grd9_upsample_center"])
def test_upsampled_grids_of_every_image(spark, folder, name):
    got = {(r.image_id, r.y, r.x): r.value for r in rows(spark, folder, name)}
    assert len(got) == IMAGES * 75 * 22
    place = (lambda i, n, new: i * (n - 1) / (new - 1)) if "corner" in name else (lambda i, n, new: min(max((i + 0.5) * n / new - 0.5, 0), n - 1))
    for (i, y, x), value in got.items():
        assert value == pytest.approx(sum(w * folder[1][i][a, b] for a, b, w in taps(round(place(y, H, 75), 9), round(place(x, W, 22), 9))), abs=1e-1)


def test_valid_patches_of_every_image(spark, folder):
    share: dict = {}
    for y in range(H):
        for x in range(W):
            share.setdefault((y // 5, x // 5), []).append(sum(w for a, b, w in turned(y, x, 45) if 0 <= a < H and 0 <= b < W))
    kept = {k: np.mean(v) for k, v in share.items() if np.mean(v) >= 0.75}
    got = {(r.image_id, r.py, r.px): r.share for r in rows(spark, folder, "prj9_valid_patches")}
    assert set(got) == {(i, *k) for i in IDS for k in kept}
    assert all(v == pytest.approx(kept[k[1:]], abs=1e-5) for k, v in got.items())


def test_component_cap_counts_all_patches(spark, folder):
    n = Counter(k // 16 % 3 for k in range(10 * 16))
    got = {(r.label, r.layer): (r.n, r.k) for r in rows(spark, folder, "fit6_component_cap")}
    assert got == {(label, layer): (c, min(12, max(2, c // 18))) for label, c in n.items() for layer in "ab"}


@pytest.mark.parametrize(
    ("name", "module", "operator", "option", "least"),
    [
        ("sta5_paired_bootstrap", stats, "paired_bootstrap", "b", 10_000),
        ("sta8_leave_one_out", stats, "leave_one_out", "b", 10_000),
        ("sta9_by_size", stats, "paired_bootstrap", "b", 10_000),
        ("sta12_cluster_bootstrap", stats, "cluster_bootstrap", "b", 2_000),
        ("sta14_interior_gain", stats, "paired_bootstrap", "b", 5_000),
        ("fit8_mixture_em", mixtures, "fit_by_key", "max_iter", 30),
        ("scr14_precision_diff", mixtures, "fit_by_key", "max_iter", 30),
    ],
)
def test_iterations_of_registered_queries(spark, monkeypatch, name, module, operator, option, least):
    class Called(Exception):
        pass

    own = inspect.signature(getattr(module, operator))

    def record(*args, **options):
        bound = own.bind(*args, **options)
        bound.apply_defaults()
        raise Called(bound.arguments[option])

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as seen:
        all_queries()[0][name](spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] == least


def blurred(m, sigma):
    """Separable Gaussian cut at four deviations, edges repeated in mirror."""
    if sigma == 0:
        return m
    r = int(4 * sigma + 0.5)
    w = np.array([math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)])
    for axis in (0, 1):
        n = m.shape[axis]
        at = [[min(j % (2 * n), 2 * n - 1 - j % (2 * n)) for j in range(i - r, i + r + 1)] for i in range(n)]
        m = np.stack([np.tensordot(w / w.sum(), np.take(m, a, axis), (0, axis)) for a in at], axis)
    return m


def doubled(m):
    for axis in (0, 1):
        n = m.shape[axis]
        m = np.apply_along_axis(lambda v, n=n: np.interp(np.linspace(0, n - 1, 2 * n), range(n), v), axis, m)
    return m


def components(mask):
    left, out = set(zip(*map(list, np.nonzero(mask)))), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(own)
    return out


def test_map_variants_equal_numpy(spark, folder):
    items = spark.read.parquet(f"{folder[0]}/lineitem.parquet").collect()
    b = {i: np.zeros((H, W)) for i in IDS}
    for r in items:
        b[r.l_suppkey][int(r.l_quantity) - 1, round(r.l_discount * 100)] += r.l_extendedprice * (1 - r.l_discount)
    got = {r.variant: r for r in rows(spark, folder, "met15_map_variants")}
    assert set(got) == {*(f"{n}_s{s}" for n in ("a", "b", "mean") for s in (0, 1, 2)), "mean_up_s4", "mean_up_s8"}
    for name, r in got.items():
        maps, masks = [], []
        for i in IDS:
            m = {"a": folder[1][i], "b": b[i], "mean": (folder[1][i] + b[i]) / 2}[name.split("_")[0]]
            mask = (folder[1][i] > 0) & (i % 3 == 0)  # every row of the fixture is a returned one
            if "_up_" in name:
                m, mask = doubled(m), mask.repeat(2, 0).repeat(2, 1)
            maps.append(blurred(m, int(name[-1])))
            masks.append(mask)
        low, high = min(m.min() for m in maps), max(m.max() for m in maps)
        levels = [np.clip(np.floor((m - low) * (65535 / (high - low))), 0, 65535) for m in maps]
        regions = [(k, own) for k, mask in enumerate(masks) for own in components(mask)]
        weight = [np.zeros(m.shape) for m in maps]
        for k, own in regions:
            for place in own:
                weight[k][place] = 1 / len(own) / len(regions)
        score, w, bad = (np.concatenate([np.asarray(v, float).ravel() for v in part]) for part in (levels, weight, masks))
        area = x = y = auroc = tp = fp = ap = 0.0
        pos, neg = bad.sum(), (1 - bad).sum()
        order = np.argsort(-score, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(score[order])) + 1):
            nx, ny = x + (1 - bad[at]).sum() / neg, y + w[at].sum()
            if x < 0.3:
                cut = min(nx, 0.3)
                top = y + (ny - y) * (cut - x) / (nx - x) if nx > x else ny
                area += (cut - x) * (y + top) / 2
            x, y = nx, ny
            p, n = bad[at].sum(), (1 - bad[at]).sum()
            auroc += n / neg * (2 * tp + p) / (2 * pos)
            tp, fp = tp + p, fp + n
            ap += p / pos * tp / (tp + fp)
        # A value on the border of two levels may fall to either side.
        assert (r.aupro, r.pixel_auroc, r.pixel_ap) == (pytest.approx(area / 0.3, abs=2e-4), pytest.approx(auroc, abs=2e-4), pytest.approx(ap, abs=2e-4))
