"""Networks: gradients, optimiser, and training on rows in several partitions."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import experiments as E
from barloom.operators import network as N


@pytest.mark.parametrize("spec", [N.Spec(hidden=(7, 5), dropout=(0.3, 0.2)), N.Spec(hidden=(6,), dropout=(0.2,), layer_norm=True), N.Spec(kind="softmax", n_out=3, hidden=(6, 4), dropout=(0.1, 0.0)), N.Spec(kind="linear", hidden=(5,), dropout=(0.4,))])
def test_gradients_equal_finite_differences(spec):
    rng = np.random.default_rng(3)
    x, weight = rng.normal(size=(40, 4)), rng.random(40) + 0.5
    y = {"sigmoid": rng.integers(0, 2, 40), "softmax": rng.integers(0, 3, 40), "linear": rng.normal(size=40)}[spec.kind].astype(float)
    w, _ = N.start(spec, 4)
    w = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in w.items()}
    at = lambda flat: N.gradients(spec, N.unpacked(flat, w), x, y, weight, np.random.default_rng(1))  # noqa: E731  the same rows drop out each time
    flat = N.packed(w)
    grad = N.packed(at(flat)[1])
    for i in rng.choice(len(flat), min(60, len(flat)), replace=False):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert grad[i] == pytest.approx((at(flat + step)[0] - at(flat - step)[0]) / 2e-5, rel=1e-4, abs=1e-6), (i, grad[i])


def test_area_and_adam():
    assert N.area(np.array([0, 0, 3]), np.array([2, 0, 0])) == 1.0 and N.area(np.array([1, 1]), np.array([1, 1])) == 0.5 and N.area(np.zeros(3), np.ones(3)) == 0.0
    adam, flat = N.Adam(0.1, 0.01), np.array([1.0, -2.0])
    flat = adam.step(flat, np.array([3.0, -1.0]))
    assert flat == pytest.approx([0.999 - 0.1, -1.998 + 0.1], abs=1e-6)  # the first step is the rate, whatever the gradient


def test_watch_halves_waits_and_keeps_the_best():
    spec, adam = N.Spec(patience=5), N.Adam(1e-3)
    watch, ends, rates = N.Watch(spec), [], []
    for k, score in enumerate([0.6, 0.7, 0.7, 0.69, 0.68, 0.67, 0.6, 0.6]):
        ends.append(watch.after(score, adam, k))
        rates.append(adam.rate)
    assert watch.weights == 1 and ends.index(True) == 6 and rates[3] == 1e-3 and rates[4] == 5e-4


def made(spark, n, y_of, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    return spark.createDataFrame(pd.DataFrame({"series_id": np.where(np.arange(n) % 2, "s", "t"), "bar_idx": np.arange(n), "a": a, "b": b, "y": y_of(a, b, rng)})).repartition(3)


def test_the_sum_over_partitions_is_that_of_one(spark, monkeypatch):
    """Without dropout, and with chunks that partitions fill alike, one step doesn't depend on where rows lie."""
    spec = N.Spec(hidden=(6,), dropout=(0.0,))
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(256, 3)), rng.integers(0, 2, 256).astype(float)
    w, moments = N.start(spec, 3)
    monkeypatch.setattr(N, "CHUNK", 64)
    rows = spark.createDataFrame(pd.DataFrame({"x": [r.tolist() for r in x], "y": y}))
    got = N.Network(spec)._step(rows.coalesce(1), w, moments, (0.5, 2.0), 0)
    want = 0
    for k in range(0, 256, 64):
        yk = y[k : k + 64]
        want = want + N.packed(N.gradients(spec, w, x[k : k + 64], yk, np.where(yk == 1, 2.0, 0.5), rng)[1])
    assert got["grad"] == pytest.approx(want) and got["size"].tolist() == [256, 4]
    many = N.Network(spec)._step(rows.repartition(4), w, moments, (0.5, 2.0), 0)
    assert many["size"][0] == 256 and np.corrcoef(many["grad"], want)[0, 1] > 0.9


def test_networks_learn_what_no_line_can(spark):
    d = made(spark, 1500, lambda a, b, rng: ((a * b > 0) ^ (rng.random(len(a)) < 0.05)).astype(float))
    fit = lambda model, **s: E.evaluated(d, ["a", "b"], "y", model, settings=s or None).preds.toPandas()
    hit = lambda p: ((p["p"] > 0.5) == p["y"]).mean()
    assert hit(fit("tf_mlp_baseline", epochs=30)) > 0.8 > 0.6 > hit(fit("logistic_baseline"))
    specs = [N.MODELS[m] for m in ("tf_mlp_baseline", "tf_mlp_bn_wd", "tf_mlp_multiclass")]
    assert len(set(specs)) == 3 and specs[1].layer_norm and specs[1].weight_decay == 1e-4 and specs[1].epochs == 60


def test_regression_network(spark):
    d = made(spark, 1200, lambda a, b, rng: np.abs(a) + 0.5 * b)
    p = E.evaluated(d, ["a", "b"], "y", "tf_mlp_regressor", settings={"epochs": 40, "rate": 1e-2}).preds.toPandas()
    assert 1 - ((p["y"] - p["p"]) ** 2).mean() / p["y"].var() > 0.6
