import numpy as np
import pandas as pd
import pytest

from barloom.operators.dependence import ahead, bounds, dependence, digamma_table, distance_correlation, mutual_information


def test_digamma():
    assert digamma_table(4).tolist() == pytest.approx([-0.5772156649, 0.4227843351, 0.9227843351, 1.2561176684])


def test_mutual_information_of_normals():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(1500)
    for rho in (0.0, 0.6, 0.9):
        y = rho * x + np.sqrt(1 - rho**2) * rng.standard_normal(1500)
        assert mutual_information(x, y) == pytest.approx(-0.5 * np.log(1 - rho**2), abs=0.06)
    assert mutual_information(x, np.ones(1500)) == 0.0 and np.isnan(mutual_information(x[:2], x[:2]))


def test_dependence_covers_all_runs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(600)
    d = pd.DataFrame({"series_id": ["a"] * 300 + ["b"] * 300, "bar_idx": [*range(300)] * 2, "f": x, "g": rng.standard_normal(600), "y": x**2})
    d.loc[0, "f"] = np.inf
    d["none"] = np.nan
    got = dependence(spark.createDataFrame(d), ["f", "g", "none"], "y", block=100).toPandas().set_index("feature")
    assert got.loc["f", "n_eff"] == 599 and got.loc["g", "n_eff"] == 600 and "none" not in got.index
    assert got.loc["f", "mi_knn"] > 1 > 0.2 > got.loc["g", "mi_knn"] and got.loc["f", "dcor"] > 0.4 > got.loc["g", "dcor"]


def test_dependence_is_that_of_the_whole_column(spark):
    step = np.repeat([0.0, 1.0], 1024)
    d = pd.DataFrame({"series_id": "a", "bar_idx": np.arange(2048), "f": step, "y": step})
    got = dependence(spark.createDataFrame(d), ["f"], "y").collect()[0]
    assert got["dcor"] == pytest.approx(1) and got["mi_knn"] > 0.6 and got["n_eff"] == 2048


def test_fast_scores_equal_those_of_all_pairs():
    rng = np.random.default_rng(6)
    for n in (2, 3, 11, 700):
        for x, y in ((rng.standard_normal(n), rng.standard_normal(n)), (rng.integers(0, 4, n).astype(float), rng.integers(0, 3, n).astype(float)), (z := rng.standard_cauchy(n), z**2)):
            a, b = (np.abs(np.subtract.outer(v, v)) for v in (x, y))
            p, q = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
            v = (p * p).mean() * (q * q).mean()
            assert distance_correlation(x, y) == pytest.approx(np.sqrt(max(0, (p * q).mean()) / np.sqrt(v)) if v else 0.0, abs=1e-6)
            if n > 3 and np.ptp(x) and np.ptp(y):
                noise = np.random.default_rng(0)
                s, t = ((w - w.mean()) / w.std() + 1e-10 * noise.standard_normal(n) for w in (x, y))
                a, b = (np.abs(np.subtract.outer(w, w)) for w in (s, t))
                r = np.nextafter(np.partition(np.maximum(a, b), 3, axis=1)[:, 3], 0)[:, None]
                psi = digamma_table(n)
                plain = psi[n - 1] + psi[2] - psi[(a <= r).sum(1) - 1].mean() - psi[(b <= r).sum(1) - 1].mean()
                assert mutual_information(x, y, block=64) == pytest.approx(max(0.0, plain), abs=1e-12)


def _columns(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n)
    d = pd.DataFrame({"series_id": np.where(np.arange(n) % 3, "a", "b"), "bar_idx": np.arange(n), "y": x})
    d["normal"], d["alone"] = 0.6 * x + 0.8 * rng.standard_normal(n), rng.standard_normal(n)
    d["steps"] = np.where(rng.random(n) < 0.4, 0.0, np.round(x))  # two fifths of the rows are equal
    d["far"] = x * np.where(rng.random(n) < 0.01, 1e4, 1.0)  # some rows lie far from all others
    d["flat"], d["gaps"] = 1.0, np.where(rng.random(n) < 0.3, np.nan, x**2)
    d["few"] = np.where(np.arange(n) < 6, x, np.nan)
    return d


@pytest.mark.parametrize("rows", [64, 250])
def test_buckets_give_what_one_column_gives(spark, rows):
    """All of a column in one task, and cut into buckets of some rows."""
    names = ["normal", "alone", "steps", "far", "flat", "gaps", "few"]
    for y in ("y", "sign"):
        d = _columns(1100, 8).assign(sign=lambda t: (t["y"] > 0).astype(float))
        frame = spark.createDataFrame(d)
        at_once = dependence(frame, names, y).toPandas().set_index("feature")
        in_buckets = dependence(frame.repartition(7), names, y, rows=rows).toPandas().set_index("feature")
        assert set(at_once.index) == set(in_buckets.index) == set(names)
        for f in names:
            for c in ("mi_knn", "dcor"):
                assert in_buckets.loc[f, c] == pytest.approx(at_once.loc[f, c], abs=1e-9, nan_ok=True), (y, f, c)
            assert in_buckets.loc[f, "n_eff"] == at_once.loc[f, "n_eff"]
        assert at_once.loc["normal", "dcor"] > 0.3 and pd.isna(at_once.loc["few", "dcor"])


def test_pairs_in_order_and_apart():
    rng = np.random.default_rng(3)
    n = 90
    p, q, x, y, g = rng.permutation(n), rng.permutation(n), rng.normal(size=n), rng.normal(size=n), None
    g = p // 20
    before = (p[:, None] < p) & (q[:, None] < q)
    pairs = (x - x[:, None]) * (y - y[:, None])
    assert ahead(p, q, x, y) == pytest.approx((pairs * before).sum()) and ahead(p, q, x, y, g) == pytest.approx((pairs * before * (g[:, None] != g)).sum())


def test_bounds_are_where_the_rounded_difference_decides():
    rng = np.random.default_rng(5)
    v, r = rng.normal(size=500), np.abs(rng.normal(size=500)) * 10.0 ** rng.integers(-12, 3, 500)
    lo, hi = bounds(v, r)
    assert (np.abs(lo - v) <= r).all() and (np.abs(hi - v) <= r).all()
    assert (np.abs(np.nextafter(lo, -np.inf) - v) > r).all() and (np.abs(np.nextafter(hi, np.inf) - v) > r).all()
