import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import ewm
from barloom.sources import files
from barloom.sources.runs import RunLog
from barloom.sources.store import Store, as_folder, as_name, dataset_parts
from barloom.streaming import bars as SB

T0 = dt.datetime(2020, 1, 1)
RAW = "series_id string, period string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def _raw(spark, minutes=(0, 5, 20)):
    return spark.createDataFrame([("BTC", "5m", T0 + dt.timedelta(minutes=m), 1.0, 2.0, 0.5, 1.5 + m, 1.0) for m in minutes], RAW)


def test_names():
    assert dataset_parts("BTC_1h_20200101_20200102") == ("BTC", "1h", "2020-01-01 00:00:00", "2020-01-02 00:00:00")
    assert dataset_parts("BTC_1h_2020-01-01 00:00:00_2020-01-02 00:00:00")[2:] == ("2020-01-01 00:00:00", "2020-01-02 00:00:00")
    with pytest.raises(FileNotFoundError):
        dataset_parts("nothing")
    assert as_name(as_folder("a b/c:d~é")) == "a b/c:d~é"


def test_datasets_are_fetched_filled_and_kept(spark, tmp_path):
    asked = []

    def fetch(*what):
        asked.append(what)
        return _raw(spark).drop("period")

    store = Store(spark, str(tmp_path), fetch)
    name = "BTC_5m_20200101_2020-01-01 01:02:00"
    got = store.load(name)
    assert got.count() == 13 and got.where("is_gap").count() == 10  # one hour, both ends
    store.load(name)
    assert len(asked) == 1 and asked[0][2] == "2020-01-01 00:00:00" and store.datasets() == [name]
    store.refresh(name)
    assert len(asked) == 2
    with pytest.raises(FileNotFoundError):
        store.refresh("x.parquet")
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path)).load("BTC_5m_20210101_20210102")


def test_columns_and_choice_of_dataset(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    d = spark.range(4).select(F.lit("a").alias("series_id"), F.col("id").alias("bar_idx"), (F.col("id") * 2).alias("f"), F.col("id").alias("pred_up__oof"), F.col("id").alias("y"))
    for name in ("one", "two"):
        store.save_column(name, "feature", "f", d)
        store.save_column(name, "target", "y", d)
    store.save_column("two", "feature", "pred_up__oof", d)
    assert sorted(r["f"] for r in store.load_column("one", "feature", "f").collect()) == [0, 2, 4, 6]
    assert store.predictions("two") == ["pred_up__oof"] and store.predictions("one") == []
    assert store.missing("one", "y", ["f", "g"]) == ["g"] and store.missing("one", "no", ["f"]) == ["no"]
    assert store.best_dataset("y", ["f", "pred_up__oof"]) == "two" and store.best_dataset("y", ["f"]) == "one" and store.best_dataset("no", []) is None
    with pytest.raises(FileNotFoundError):
        store.load_column("one", "feature", "none")


def test_artifacts_are_made_again_when_bars_grow(spark, tmp_path):
    store, made = Store(spark, str(tmp_path)), []

    def make(bars):
        made.append(1)
        return bars.withColumn("twice", F.col("bar_idx") * 2)

    bars = lambda n: spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("bar_idx"))
    assert store.artifact(bars(5), "d", "pv", make).count() == 5
    assert store.artifact(bars(5), "d", "pv", make).count() == 5 and len(made) == 1
    assert store.artifact(bars(6), "d", "pv", make).count() == 6 and len(made) == 2


def test_csv_and_json(spark, tmp_path):
    files.write_csv(_raw(spark).withColumnRenamed("ts", "Date"), str(tmp_path / "x.csv"), one_file=True)
    got = files.read_table(spark, str(tmp_path / "x.csv"))
    assert dict(got.dtypes)["ts"] == "timestamp_ntz" and dict(got.dtypes)["close"] == "double" and got.agg(F.max("ts")).first()[0] == T0 + dt.timedelta(minutes=20)
    files.write_json(got, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_database_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    try:
        _raw(spark, range(0, 60, 5)).withColumn("ts", F.col("ts").cast("timestamp")).write.option("createTableColumnTypes", "series_id VARCHAR(20), period VARCHAR(8)").jdbc(url, "bars", mode="overwrite")
    except Exception as e:
        pytest.skip(f"no database driver: {e!r:.80}")
    fetch = files.jdbc(spark, url, "bars", parts=3)
    got = fetch("BTC", "5m", "2020-01-01 00:10:00", "2020-01-01 00:30:00")
    assert got.count() == 5 and fetch("ETH", "5m", "2020-01-01 00:10:00", "2020-01-01 00:30:00").count() == 0
    assert Store(spark, str(tmp_path / "s"), fetch).load("BTC_5m_2020-01-01 00:10:00_2020-01-01 00:30:00").count() == 5


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    assert log.runs().count() == 0 and not log.exists("k1")
    a = log.create("k1", {"target": "up", "features": ["f"]})
    log.start(a)
    log.succeed(a, {"auc": 0.6})
    b = log.create("k2", {"target": "up", "features": []})
    log.start(b)
    log.fail(b, "no rows")
    with pytest.raises(ValueError):
        log.create("k1", {})
    for runs in (log.runs(), log.compact(str(tmp_path / "compact")).runs()):
        got = {r["run_key"]: r for r in runs.collect()}
        assert got["k1"]["status"] == "SUCCESS" and got["k1"]["started_at"] and "0.6" in got["k1"]["metrics_json"] and got["k2"]["status"] == "FAILED" and got["k2"]["error_msg"] == "no rows"
    assert log.selection(a)["target"] == "up" and log.selection(a)["eval_cfg"] == "default"
    with pytest.raises(RuntimeError):
        log.selection("none")


def _tick_files(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(path)


def test_stream_of_bars_and_tail(spark, tmp_path):
    ticks = [("a", T0 + dt.timedelta(minutes=m), float(m)) for m in range(0, 60)]
    _tick_files(spark, str(tmp_path / "in"), [ticks[:30], ticks[30:]])
    stream = spark.readStream.schema("series_id string, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    q = SB.score_tail(SB.closed_bars(stream), str(tmp_path / "bars"), str(tmp_path / "ck"), lambda t, k: seen.__setitem__(k, t.toPandas()), rows=4, availableNow=True)
    assert q.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "bars"))
    assert kept.count() == kept.select("ts").distinct().count() == 9  # 00:40 to 00:45 is closed by a watermark of 00:49
    last = seen[max(seen)].sort_values("bar_idx")
    assert last["close"].tolist() == [29.0, 34.0, 39.0, 44.0]


def test_smoothing_carries_its_state(spark, tmp_path):
    x = [1.0, 3.0, 2.0, 8.0, 5.0, 4.0]
    rows = [("a", T0 + dt.timedelta(minutes=m), v) for m, v in enumerate(x)]
    _tick_files(spark, str(tmp_path / "in"), [rows[:2], rows[2:5], rows[5:]])
    stream = spark.readStream.schema("series_id string, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = SB.smoothed(stream, 0.3, "value").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("ts")
    assert got["ewm"].tolist() == pytest.approx(ewm.ewm_mean(pd.Series(x), 0.3).tolist())
