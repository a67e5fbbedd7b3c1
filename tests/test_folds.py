"""Runs evaluated over folds, and runs of more than two classes."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import search
from barloom.operators import experiments as E
from barloom.operators import scores as S
from barloom.registry import Registry
from barloom.sources.runs import RunLog
from barloom.sources.store import Store


def made(spark, n, y_of):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    return spark.createDataFrame(pd.DataFrame({"series_id": "s", "bar_idx": np.arange(n), "close": 100 + a, "a": a, "b": b, "y": y_of(a, b, rng)}))


def plain_auc(y, p):
    one, zero = p[y == 1], p[y == 0]
    if not len(one) or not len(zero):
        return np.nan
    gap = one[:, None] - zero[None]
    return ((gap > 0) + 0.5 * (gap == 0)).mean()


def plain_ap(y, p):
    if not y.sum():
        return 0.0
    total = 0.0
    for t in np.unique(p):
        at = p >= t
        total += y[p == t].sum() / y.sum() * y[at].sum() / at.sum()
    return total


def test_folds_train_on_what_lies_before_and_sum_up_as_by_hand(spark):
    d = made(spark, 611, lambda a, b, rng: (a + 0.7 * rng.standard_normal(len(a)) > 0).astype(float))
    done = E.evaluated(d, ["a", "b"], "y", "logistic_baseline", "expanding")
    p = done.preds.toPandas()
    size = 611 // 6
    assert [t["n_train"] for t in done.train] == [611 - (5 - k) * size for k in range(5)]
    for k, own in p.groupby("fold"):
        assert sorted(own["bar_idx"]) == list(range(611 - (5 - k) * size, 611 - (4 - k) * size))
    # by hand, from the same predictions
    aucs = [plain_auc(o["y"].to_numpy(), o["p"].to_numpy()) for _, o in p.groupby("fold")]
    aps = [plain_ap(o["y"].to_numpy(), o["p"].to_numpy()) for _, o in p.groupby("fold")]
    got = S.fold_summary(S.over_folds(done.preds.withColumn("run_id", F.lit("r")), tie="bar_idx")).first()
    want = {"auc_median": np.median(aucs), "auc_mean": np.mean(aucs), "auc_q025": np.quantile(aucs, 0.025), "auc_q975": np.quantile(aucs, 0.975), "ap": np.median(aps), "ap_mean": np.mean(aps)}
    assert {k: got[k] for k in want} == pytest.approx(want) and got["folds"] == 5 and min(aucs) > 0.7


def test_a_fold_of_one_class_is_left_out(spark):
    d = made(spark, 600, lambda a, b, rng: np.where(np.arange(len(a)) < 250, 0.0, (a > 0).astype(float)))
    d = d.withColumn("late", F.when(F.col("bar_idx") >= 150, F.col("b")))  # null throughout the first fold's rows
    done = E.evaluated(d, ["a", "late"], "y", "logistic_baseline", "expanding")
    assert [t["fold"] for t in done.train] == [2, 3, 4]  # the first two train on zeros only
    assert E.evaluated(d.withColumn("y", F.lit(1.0)), ["a"], "y", "logistic_baseline", "expanding").preds is None


def test_multiclass_metrics_by_hand(spark):
    rng = np.random.default_rng(1)
    p, label = np.round(rng.dirichlet([1, 1, 1], 300), 2), rng.integers(0, 3, 300)
    rows = [("r", i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(label, p, strict=True))]
    rows += [("gap", i, int(k > 0), [float(x) for x in q]) for i, (k, q) in enumerate(zip(label, p, strict=True))]  # no row of the last class
    got = {r["run_id"]: r for r in S.multiclass(spark.createDataFrame(rows, "run_id string, row_id long, label int, p array<double>")).collect()}
    aucs = [plain_auc((label == k).astype(int), p[:, k]) for k in range(3)]
    aps = [plain_ap((label == k).astype(int), p[:, k]) for k in range(3)]
    assert (got["r"]["auc"], got["r"]["ap"], got["r"]["accuracy"]) == pytest.approx((np.mean(aucs), np.mean(aps), (p.argmax(axis=1) == label).mean()))
    aps = [plain_ap(((label > 0).astype(int) == k).astype(int), p[:, k]) for k in range(3)]
    assert got["gap"]["auc"] is None and got["gap"]["ap"] == pytest.approx(np.mean(aps)) and aps[2] == 0 and got["gap"]["classes"] == 3


@pytest.fixture
def lab(spark, tmp_path):
    d = made(spark, 700, lambda a, b, rng: (a + 0.5 * rng.standard_normal(len(a)) > 0).astype(float)).withColumns({"y3": F.when(F.col("a") > 0.4, 1.0).when(F.col("a") < -0.4, -1.0).otherwise(0.0), "value": 2 * F.col("a") + F.col("b")})
    d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("bar_idx") * 300))
    r = Registry()
    r.register_family("features", lambda b: b.select("series_id", "bar_idx", "a", "b"), ["a", "b"])
    r.register_family("targets", lambda b: b.select("series_id", "bar_idx", "y", "y3", "value"), ["y", "y3", "value"])
    for name in ("rf_baseline", "hgb_baseline", "logistic_baseline", "tf_mlp_multiclass"):
        r.register_model(name)
    r.register_model("tf_mlp_regressor", "reg")
    settings = {"tf_mlp_multiclass": {"epochs": 12, "rate": 3e-2}, "tf_mlp_regressor": {"epochs": 15, "rate": 3e-2}, "rf_baseline": {"numTrees": 5, "minInstancesPerNode": 20}, "hgb_baseline": {"rounds": 8, "least_rows": 20}}
    r.register_eval_cfg("default", {"split": "time", "gap": 0, "settings": settings})
    r.register_eval_cfg("walk", {"split": "walk", "gap": 12, "settings": settings})
    made_lab = search.Lab(spark, Store(spark, f"file://{tmp_path}/store"), RunLog(spark, f"file://{tmp_path}/runs"), r, f"file://{tmp_path}/weights.json")
    made_lab.store.save("d", d)
    return made_lab


def metrics_of(lab, run_id):
    return json.loads(lab.runs.runs().where(F.col("run_id") == run_id).first()["metrics_json"])


@pytest.mark.parametrize(("model", "target", "cfg", "folds"), [("rf_baseline", "y", "default", 5), ("hgb_baseline", "y", "default", 5), ("logistic_baseline", "y", "walk", 4), ("tf_mlp_multiclass", "y3", "walk", 4)])
def test_runs_record_their_folds(lab, model, target, cfg, folds):
    m = metrics_of(lab, lab.run("d", "s", {"target": target, "features": ["a", "b"], "model": model, "eval_cfg": cfg}))
    assert m["folds"] == folds and m["auc_q025"] <= m["auc_median"] == m["auc"] <= m["auc_q975"] and m["auc"] > 0.8 and m["ap"] > 0.7 and m["ap_mean"] > 0.7
    assert m["n_test"] == (580 if folds == 5 else 560)
    if target == "y":
        assert 0.4 < m["pos_rate_test"] < 0.6 and 0.4 < m["pos_rate_train"] < 0.6


def test_a_run_of_three_classes_is_scored(lab):
    m = metrics_of(lab, lab.run("d", "s", {"target": "y3", "features": ["a", "b"], "model": "tf_mlp_multiclass"}))
    assert m["auc"] > 0.9 and m["ap"] > 0.8 and m["accuracy"] > 0.6 and m["classes"] == 3 and m["n_test"] == 140


def test_a_regression_walks(lab):
    one, walk = (metrics_of(lab, lab.run("d", "s", {"target": "value", "features": ["a", "b"], "model": "tf_mlp_regressor", "eval_cfg": cfg})) for cfg in ("default", "walk"))
    assert one["skill"] > 0.5 and walk["skill"] > 0.3 and walk["folds"] == 4 and "folds" not in one


def test_runs_on_record_are_validated_by_id(lab, spark):
    """Families are computed once; refits over gaps, walk-forward folds and stored predictions take a run's id."""
    calls = []
    make = lab.registry.features["a"]
    for n in ("a", "b"):
        lab.registry.features[n] = counted = lambda b: calls.append(1) or make(b)
    lab.registry.features["a"] = counted
    run = lab.run("d", "s", {"target": "y", "features": ["a", "b"], "model": "logistic_baseline"})
    assert len(calls) == 1 and lab.best_runs(3) == [run]
    got = lab.validate([run], "d", gaps=(0, 24)).collect()
    assert sorted((r["run_id"], r["gap"], r["n"]) for r in got) == [(run, 0, 140), (run, 24, 116)]
    assert all(r["auc"] > 0.8 > r["auc_perm"] for r in got)
    folds = lab.walk_forward(run, "d").collect()
    assert len(folds) == 4 and all(r["auc"] > 0.8 for r in folds)
    name = lab.prediction_feature(run, "d")
    assert name == "pred_y__logistic_baseline__oof" and name in lab.registry.features
    assert lab.registry.get_feature(name)(None).where(F.col(name).isNotNull()).count() == 560
    assert lab.prediction_feature(run, "d") == name and lab.register_predictions("d") == []
    other = search.Lab(spark, lab.store, lab.runs, Registry(targets=dict(lab.registry.targets), features={"a": make, "b": make}), lab.weights_path)
    assert other.register_predictions("d") == [name]
