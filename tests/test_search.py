"""Registry, weight store, draws, runs and the loop."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom import search
from barloom.operators import features as FT
from barloom.operators import history as H
from barloom.operators import targets as T
from barloom.operators import technical as TA
from barloom.registry import Registry, builtin, compute
from barloom.sources.runs import RunLog
from barloom.sources.store import Store
from barloom.sources.weights import WeightStore


@pytest.fixture(scope="module")
def bars(spark):
    x = F.col("bar_idx")
    price = 100 + 10 * F.sin(x / 7) + (x * 37 % 11) / 5
    return spark.range(400).select(F.lit("s").alias("series_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id") * 5)).alias("ts"), F.col("id").alias("bar_idx")).select(
        "*", price.alias("open"), (price + 1).alias("high"), (price - 1).alias("low"), (price + (x * 17 % 5) / 10).alias("close"), (x % 13 + 1.0).alias("volume"), F.lit(3.0).alias("n_trades")
    )


def test_names_are_unique_within_a_kind():
    r = Registry()
    r.register_feature("a")(FT.momentum)
    r.register_target("a")(T.future)
    with pytest.raises(ValueError, match="registered already"):
        r.register_feature("a")(FT.volume)
    with pytest.raises(KeyError, match="not registered"):
        r.get_model("a")
    r.register_eval_cfg("x", {"gap": 3})
    assert r.get_eval_cfg("x") == {"gap": 3} and r.get_target("a") is T.future


def test_an_indicator_registers_each_of_its_columns(spark):
    r = Registry()
    names = r.discover(spark, "features", TA.recursive_indicators)
    assert {"ta_momentum_macd", "ta_momentum_macd_signal", "ta_momentum_macd_hist"} <= set(names) == set(r.features)


def test_builtin_families(spark, bars):
    r = builtin(spark)
    assert len(r.features) > 200 and {"future_up", "up_margin_H12_k075", "pv_phase_up"} <= set(r.targets) and r.models["hgb_regressor"] == "reg"
    got = compute(bars, {n: r.get_feature(n) for n in ("pct_change", "tod_sin", "momentum_3")})
    assert got.columns == ["series_id", "bar_idx", "pct_change", "tod_sin", "momentum_3"] and got.count() == 400


def test_draws_follow_weights():
    found = Counter(search.draw(k, {"a": 1.0, "b": 3.0, "c": 0.0})[0] for k in range(4000))
    assert found["c"] == 0 and 0.7 < found["b"] / 4000 < 0.8
    assert sorted(search.draw(1, {"a": 0.0, "b": 0.0}, 5)) == ["a", "b"]


def test_weight_document(spark, tmp_path):
    path = f"file://{tmp_path}/weights.json"
    w = WeightStore.load(spark, path)
    assert w.disabled_models == ["rf_baseline", "logistic_baseline"] and w.disabled_targets == ["updown_margin_H12_k075"]
    w.toggle("feature", "f", False)
    w.features["ü"] = 0.25
    w.save(spark, path)
    again = WeightStore.load(spark, path)
    assert again == w and again.weight("feature", "f") == 0.0 and again.weight("feature", "ü") == 0.25 and again.weight("feature", "new") == 1.0
    rows = {(r["kind"], r["name"]): r for r in again.long_form(spark).collect()}
    assert rows["feature", "f"]["disabled"] and rows["model", "rf_baseline"]["disabled"] and not rows["feature", "ü"]["disabled"]
    assert WeightStore.reset(spark, path).features == {}
    with open(tmp_path / "weights.json", "w") as f:
        f.write("{broken")
    with pytest.raises(ValueError, match="no weight document"):
        WeightStore.load(spark, path)


def test_store_and_fold_learn_alike(spark):
    """The document updated run by run, and the fold of all runs' events in chunks."""
    w = WeightStore(features={"a": 0.5, "z": 0.0}, disabled_features=["d"], features_stats={"a": {"n": 4, "mean": 0.5, "best": 0.6, "last": 0.1}})
    start = w.long_form(spark)
    events = []
    for k in range(30):
        used, failed, score = [f for f in "abdz" if (k + ord(f)) % 3], ["b"] * (k % 7 == 0) + ["x"] * (k == 9), None if k % 5 == 0 else (k * 37 % 100) / 100
        own = {f: (k * ord(f) % 50) / 50 for f in used if f not in failed}
        w.update({"target": f"t{k % 2}", "features": used, "model": "m"}, score, own, failed)
        if score is not None:
            events += [("target", f"t{k % 2}", k, score, False), ("model", "m", k, score, False), ("k", f"k_{len(used)}", k, score, False)]
        events += [("feature", f, k, own.get(f, 0.0), f in failed) for f in used] + [("feature", f, k, None, True) for f in failed if f not in used]
    rows = spark.createDataFrame(events, "kind string, name string, seq long, score double, failed boolean")
    for chunk in (4, 4096):
        got = {(r["kind"], r["name"]): r for r in H.weight_updates(rows, start, chunk=chunk).collect()}
        for r in w.long_form(spark).collect():
            mine = got[r["kind"], r["name"]]
            assert mine["weight"] == pytest.approx(r["weight"]), r
            if r["kind"] != "k":
                assert (mine["n"], mine["disabled"]) == (r["n"], r["disabled"]) and mine["mean"] == pytest.approx(r["mean"]) and mine["best"] == pytest.approx(r["best"]), r


def test_selection_keeps_its_bounds():
    r = Registry()
    r.register_family("features", FT.momentum, [f"f{k}" for k in range(30)] + ["pred_t__m__oof"])
    r.register_target("t")(T.future)
    r.register_model("clf_model")
    r.register_model("reg_model", "reg")
    w = WeightStore(disabled_features=["f0"], features={"f1": 0.0})
    pick = lambda facts, seed=1, **how: search.build_selection(r, w, lambda t: facts, seed, **how)
    for seed in range(20):
        s = pick(search.Facts(1000, 500, True, "clf"), seed)
        assert 8 <= len(s["features"]) <= 20 and not {"f0", "f1", "pred_t__m__oof"} & set(s["features"]) and s["model"] == "clf_model"
    assert len(pick(search.Facts(1000, 17, True, "clf"))["features"]) == 2 and len(pick(search.Facts(8, 0, False, "reg"))["features"]) == 1
    assert pick(search.Facts(1000, 0, False, "reg"))["model"] == "reg_model"
    s = search.select_components(r, 3)
    assert 1 <= len(s["features"]) <= 3 and s["eval_cfg"] == "default"


def test_loop_records_learns_and_refuses_repeats(spark, bars, tmp_path):
    r = Registry()
    r.register_family("features", FT.momentum, ["pct_change", "momentum_3"])
    r.register_target("future_up")(T.future)
    r.register_feature("broken")(lambda b: b.select("series_id", "bar_idx", F.expr("raise_error('no')").cast("double").alias("broken")))
    r.register_model("logistic_baseline")
    lab = search.Lab(spark, Store(spark, f"file://{tmp_path}/store"), RunLog(spark, f"file://{tmp_path}/runs"), r, f"file://{tmp_path}/weights.json")
    lab.store.save("d", bars)
    w = WeightStore.load(spark, lab.weights_path)
    w.toggle("model", "logistic_baseline", True)
    w.features_audit = {f: {} for f in r.features}
    w.save(spark, lab.weights_path)
    selection = {"target": "future_up", "features": ["broken", "pct_change", "pred_future_up__x"], "model": "logistic_baseline"}
    first = lab.run("d", "s", selection)
    assert first and lab.run("d", "s", selection) is None
    row = lab.runs.runs().where(F.col("run_id") == first).first()
    assert row["status"] == "SUCCESS" and '"id": "broken"' in row["artifacts_json"] and "pred_future_up" not in row["selection_json"]
    lab.learn(first, w)
    assert w.features["broken"] == pytest.approx(0.4) and w.features_stats["pct_change"]["n"] == 1 and w.targets_stats["future_up"]["n"] == 1
    with pytest.raises(RuntimeError, match="no feature"):
        lab.run("d", "s", selection | {"features": ["broken"]})
    assert lab.runs.runs().where("status = 'FAILED'").count() == 1
    w.toggle("feature", "broken", False)
    w.save(spark, lab.weights_path)
    ids = lab.loop("d", "s", 1, seed=5, nfeat_min=1, nfeat_max=2)
    after = WeightStore.load(spark, lab.weights_path)
    assert ids[0] and after.k_weights and "logistic_baseline" in after.disabled_models and "broken" in after.disabled_features


def test_bump_adds_names(spark):
    w = WeightStore(features={"a": 2.0}).long_form(spark)
    assert {r["name"]: r["weight"] for r in H.bump(w, ["a", "b"], factor=2.0).collect()} == {"a": 4.0, "b": 2.0}
    assert {r["name"]: r["weight"] for r in H.bump(w, ["b"]).collect()} == {"a": 2.0, "b": 3.0}


def test_a_look_ahead_within_the_day_is_seen_where_prefixes_end_with_days(spark):
    x = F.col("id")  # 10 days: each checkpoint is a whole number of them
    ten = spark.range(2880).select(F.lit("s").alias("series_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=x * 5)).alias("ts"), x.alias("bar_idx"), *[(100 + x * 37 % 11).cast("double").alias(c) for c in ("open", "high", "low", "close")], (x % 13 + 1.0).alias("volume"), F.lit(3.0).alias("n_trades"))
    r, w = Registry(), WeightStore()
    r.register_family("features", FT.volume, ["vol_sum_1d_cal", "vol_sum_1d_roll"])
    search.audit_candidates(ten, r, w)
    assert w.disabled_features == ["vol_sum_1d_cal"] and w.features_audit["vol_sum_1d_cal"]["flag_prefix"]
