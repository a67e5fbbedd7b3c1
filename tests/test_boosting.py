"""Histogram boosting against a plain version that splits one leaf at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from barloom.operators import boosting as B
from barloom.operators import experiments as E


def plain_boosting(bins, y, held, spec):
    """Scores of all rows, and the number of leaves of each tree: every node keeps its rows, every split looks at all of them."""
    base = y[~held].mean()
    base = np.log(base / (1 - base)) if spec.kind == "log" else base
    score, log, sizes = np.full(len(y), base), [], []
    for _ in range(spec.rounds):
        log.append(B.losses(spec.kind, score[held], y[held]).mean())
        if len(log) > spec.patience and spec.early_stop and min(log[-spec.patience :]) >= log[-spec.patience - 1] - spec.tolerance:
            break
        g, h = B.slopes(spec.kind, score, y)

        def best(rows):
            rows, found = rows[~held[rows]], (0.0, None, None)
            whole = g[rows].sum() ** 2 / h[rows].sum()
            for k in range(bins.shape[1]):
                for b in np.unique(bins[rows, k])[:-1]:
                    low = bins[rows, k] <= b
                    left, right = rows[low], rows[~low]
                    if min(len(left), len(right)) < spec.least_rows or min(h[left].sum(), h[right].sum()) < B.LEAST_CURVATURE:
                        continue
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - whole
                    if gain > found[0] * (1 + 1e-12):
                        found = (gain, k, b)
            return found

        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(leaves) < spec.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            rows, (gain, k, b) = leaves[at]
            if k is None:
                break
            low = bins[rows, k] <= b
            leaves[at : at + 1] = [(part, best(part)) for part in (rows[low], rows[~low])]
        sizes.append(len(leaves))
        step = np.zeros(len(y))
        for rows, _ in leaves:
            own = rows[~held[rows]]
            step[rows] = -spec.rate * g[own].sum() / h[own].sum()
        score = score + step
    return score, sizes


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 3)), 1)
    signal = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0)
    return x, signal + 0.3 * rng.standard_normal(n), rng.random(n) < 0.1


@pytest.mark.parametrize("kind", ["log", "squared"])
def test_equals_the_plain_version(spark, kind, monkeypatch):
    monkeypatch.setattr(B, "REWRITE", 4)
    monkeypatch.setattr(B, "BLOCK", 300)
    x, value, held = data(2000)
    y = (value > 0).astype(float) if kind == "log" else value
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "held": held}))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows).repartition(3)
    spec = B.Spec(kind=kind, rounds=10, leaves=9, least_rows=60, rate=0.3)
    model = B.Boosting(spec).fit(rows)
    want, sizes = plain_boosting(B.binned(x, model.edges), y, held, spec)
    bins = B.binned(x, model.edges)
    got = model.base + sum(t.predict(bins) for t in model.trees)
    assert [sum(left < 0 for left in t.left) for t in model.trees] == sizes and max(sizes) == 9
    assert got == pytest.approx(want, abs=1e-9)
    p = model.transform(rows).toPandas()["p"]
    assert sorted(p) == pytest.approx(sorted(want if kind == "squared" else 1 / (1 + np.exp(-want))), abs=1e-9)


def test_stops_when_held_rows_gain_nothing():
    spec = B.Spec(patience=10)
    assert not B.stops(spec, [*range(20, 0, -1)]) and B.stops(spec, [5, 4, 3, *[3.5] * 10]) and not B.stops(spec, [5, 4, 3, *[3.5] * 9])
    assert (spec.rounds, spec.leaves, spec.least_rows, spec.rate, B.BINS) == (600, 31, 100, 0.05, 255)


def test_training_stops_by_the_held_rows(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(1200), rng.standard_normal(1200)
    d = spark.createDataFrame(pd.DataFrame({"series_id": "s", "bar_idx": np.arange(1200), "a": a, "b": b, "y": 3 * a + b * b + 0.1 * rng.standard_normal(1200)}))
    d, _ = E.labelled(d, "hgb_regressor")
    model = E.estimator("hgb_regressor", 1200, ["a", "b"], settings={"rate": 0.3}).fit(d).stages[-1]
    assert 11 <= len(model.trees) < 200


def test_no_split_where_there_are_too_few_rows():
    hist = B.histograms(np.zeros((50, 2), np.uint8), np.zeros(50, int), np.ones(50), np.ones(50), 1)[0]
    assert B.best_split(hist, 1) is None
    tree = B.grow(B.Spec(), hist, None)
    assert tree.left == [-1] and tree.value[0] == pytest.approx(-0.05)
