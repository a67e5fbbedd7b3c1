"""Catalog, transforms for names, grades, listings and Excel files."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import catalog as C
from barloom.operators import features as FT
from barloom.operators import staged
from barloom.operators import validation as V
from barloom.registry import Registry
from barloom.sources import files
from barloom.sources.weights import WeightStore


@pytest.fixture
def registry(spark):
    r = Registry()
    r.discover(spark, "features", FT.momentum)
    r.discover(spark, "features", staged.indicators)
    return r


def test_catalog_of_indicators(spark, registry):
    rows = C.catalog(spark, registry)
    kept = C.filtered(rows).where("verdict = 'kept'")
    assert kept.count() == rows.count() == len(staged.INDICATORS)
    assert {r["category"] for r in kept.select("category").distinct().collect()} <= set(C.KEPT)


def test_transforms_are_registered_once(spark, registry, monkeypatch, tmp_path):
    assert C.register_transforms(registry, ["pct_change", "unknown"]) == ["pct_change_diff1", "pct_change_pct1", "pct_change_vel_ema"]
    assert C.register_transforms(registry, ["pct_change"]) == []
    store = WeightStore(features={"momentum_3_diff1": 1.0, "nothing_pct1": 1.0, "pct_change_diff1": 1.0}, features_stats={"rolling_std_5": {"n": 50, "mean": 0.9, "best": 1.0}, "ta_candles_cdl_z_open": {"n": 50, "mean": 0.95, "best": 1.0}, "pct_change_diff1": {"n": 50, "mean": 0.99, "best": 1.0}})
    assert C.for_weight_keys(registry, store) == ["momentum_3_diff1"]
    assert C.for_top(registry, store.long_form(spark), 3) == ["rolling_std_5_diff1", "rolling_std_5_pct1", "rolling_std_5_vel_ema"]
    path = f"file://{tmp_path}/w.json"
    WeightStore(features={"volume_change_vel_ema": 1.0}).save(spark, path)
    monkeypatch.setenv("WEIGHTS_JSON", path)
    assert C.from_environment(spark, registry) == ["volume_change_vel_ema"]
    bars = spark.range(50).selectExpr("'s' as series_id", "id as bar_idx", "cast(id % 7 as double) as close", "1.0D as volume")
    got = registry.get_feature("momentum_3_diff1")(bars).orderBy("bar_idx").collect()
    assert len(got) == 50 and got[4]["momentum_3_diff1"] == 0.0


def test_grades(spark):
    d = spark.createDataFrame([(0.5, 0.3, 0.3), (0.6, 0.3, 0.3), (None, None, None), (0.9, 1.0, 0.99)], "auc double, ap double, base double")
    g = V.permutation_grade(F.col("auc"), F.col("ap"), F.col("base"))
    assert [(round(r[0], 6), r[1]) for r in d.select(g, V.label(g)).collect()] == [(5.0, "excellent"), (2.0, "acceptable"), (0.0, "very poor"), (1.6, "poor")]
    assert spark.range(1).select(V.regression_grade(F.lit(None).cast("double"), F.lit(0.5))).first()[0] == 2.5
    assert [r[0] for r in spark.createDataFrame([("12.5 %",), ("x",), (None,), ("50",)], "p string").select(V.fraction(F.col("p"))).collect()] == [0.125, None, None, 0.5]


def test_folds_and_gaps(spark):
    bars = spark.range(600).selectExpr("'s' as series_id", "id as bar_idx", "cast(id % 9 as double) as a", "cast(id % 4 as double) as b", "cast(id % 9 > 4 as int) as y")
    got = V.over_gaps({"r": (bars, ["a", "b"], "y", "logistic_baseline")}, (0, 12)).orderBy("gap").collect()
    assert [r["gap"] for r in got] == [0, 12] and all(r["auc"] > 0.99 and r["auc_perm"] < 0.75 and r["run_id"] == "r" for r in got) and got[0]["n"] > got[1]["n"]


def test_excel_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a & b", 1.5, 2, None), ("<ü>", None, 3, "x")], "name string, v double, n int, none string")
    files.write_excel(d, f"file://{tmp_path}/t.xlsx")
    got = files.read_excel(spark, f"file://{tmp_path}/t.xlsx")
    assert [tuple(r) for r in got.collect()] == [("a & b", 1.5, 2.0, None), ("<ü>", None, 3.0, "x")] and dict(got.dtypes)["v"] == "double"
    none = d.where("false")
    files.write_excel(none, f"file://{tmp_path}/e.xlsx")
    assert files.read_excel(spark, f"file://{tmp_path}/e.xlsx").columns == d.columns


def test_normalized_to_the_range_of_another(spark):
    d = spark.createDataFrame([("s", 0, 1.0, 10.0), ("s", 1, 3.0, 30.0), ("t", 0, 5.0, 1.0), ("t", 1, 5.0, 3.0)], "series_id string, bar_idx long, a double, b double")
    assert [r["x"] for r in V.normalized_like(d, "a", "b", "x").orderBy("series_id", "bar_idx").collect()] == [0.0, 20.0, 1.0, 1.0]
    assert tuple(V.color_bounds(d.where("series_id = 't'"), ["a"]).first()) == (0.0, 1.0)


def test_catalog_is_stored_and_parameters_are_filled_from_bars(spark, tmp_path):
    rows = spark.createDataFrame([
        ("momentum", "rsi", "(close)", ["close"], "strength"), ("trend", "zigzag", "(close)", ["close"], None), ("cycles", "ebsw", "(close)", ["close"], None), ("volume", "none", None, None, None),
    ], C.SCHEMA)
    doc = C.document(rows, "1")
    assert doc["total_count"] == 1 and doc["kept_categories"] == ["momentum"] and doc["excluded_categories"] == ["cycles"] and doc["flagged_lookahead"] == [{"category": "trend", "indicator": "zigzag"}]
    C.save(spark, doc, f"file://{tmp_path}/catalog.json")
    assert [tuple(r) for r in C.load(spark, f"file://{tmp_path}/catalog.json").collect()] == [("momentum", "rsi", "(close)", ["close"], "strength")]
    have = ["open", "high", "low", "close"]
    assert set(C.arguments(["high", "l", "close", "c", "length", "vol", "hl2"], have)) == {"high", "l", "close", "hl2"} and set(C.arguments(["c"], have)) == {"c"}
    r = Registry()
    assert C.register_indicator(r, "ta_x", lambda high, l: 2 * high - l, ["high", "l"], have) and not C.register_indicator(r, "ta_x", lambda high: high, ["high"], have)  # noqa: E741
    assert not C.register_indicator(r, "ta_y", lambda volume: volume, ["volume"], have) and not C.register_indicator(r, "ta_z", lambda other: other, ["other"], have)
    bars = spark.createDataFrame([("s", 0, 1.0, 3.0, 1.0, 2.0), ("s", 1, 1.0, None, 1.0, 2.0)], "series_id string, bar_idx long, open double, high double, low double, close double")
    assert [r["ta_x"] for r in r.get_feature("ta_x")(bars).orderBy("bar_idx").collect()] == [5.0, 0.0]
