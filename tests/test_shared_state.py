"""What several writers share: the weight document, run keys, and the filter of known keys."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.sources import membership as M
from barloom.sources import weights as W
from barloom.sources.runs import RunLog
from barloom.sources.shared import create_exclusively
from barloom.sources.weights import WeightStore

RUN = {"target": "t", "features": ["a", "b"], "model": "m"}


def test_two_interleaved_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/w.json"
    WeightStore(features={"a": 1.0, "z": 0.5}).save(spark, path)
    one, two = WeightStore.load(spark, path), WeightStore.load(spark, path)
    one.update(RUN, 0.6, {"a": 0.3}, [])
    one.toggle("feature", "z", False)
    two.update(RUN | {"features": ["a"]}, 0.8, {"a": 0.9}, ["bad"])
    two.features_audit["a"] = {"nan_rate": 0.1}
    two.disabled_models.remove("rf_baseline")
    one.save(spark, path)
    two.save(spark, path)
    got = WeightStore.load(spark, path)
    want = WeightStore(features={"a": 1.0, "z": 0.5})
    want.update(RUN, 0.6, {"a": 0.3}, [])
    want.toggle("feature", "z", False)
    want.update(RUN | {"features": ["a"]}, 0.8, {"a": 0.9}, ["bad"])
    assert got.features == want.features and got.features_stats == want.features_stats and got.targets_stats["t"]["n"] == 2 and got.k_weights == want.k_weights
    assert got.disabled_features == ["z"] and got.features_audit == {"a": {"nan_rate": 0.1}} and got.features["bad"] == 0.5
    two.update(RUN, 0.5, {}, [])  # goes on from what it has merged
    two.save(spark, path)
    assert WeightStore.load(spark, path).targets_stats["t"]["n"] == 3


def test_many_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/w.json"

    def learn(k):
        for i in range(4):
            w = WeightStore.load(spark, path)
            w.update({"target": f"t{k}", "features": ["f"], "model": "m"}, 0.5, {"f": 0.5}, [])
            w.save(spark, path)

    threads = [threading.Thread(target=learn, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = WeightStore.load(spark, path)
    assert got.models_stats["m"]["n"] == 12 and [got.targets_stats[f"t{k}"]["n"] for k in range(3)] == [4, 4, 4]
    assert len([n for n in os.listdir(tmp_path / "w.json.d") if n.endswith(".json")]) <= W.KEPT


def test_a_dead_writers_claim_is_given_up(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w.json"
    monkeypatch.setattr(W, "STALE", 0.0)
    os.makedirs(tmp_path / "w.json.d")
    (tmp_path / "w.json.d" / "000000001.claim").touch()
    WeightStore(features={"a": 0.25}).save(spark, path)
    assert WeightStore.load(spark, path).features == {"a": 0.25}


def test_keys_without_a_run_are_freed(spark, tmp_path):
    log = RunLog(spark, f"file://{tmp_path}/runs")
    log.create("ran", {"target": "t"})
    assert create_exclusively(spark, f"file://{tmp_path}/runs-keys/died")
    with pytest.raises(ValueError):
        log.create("died", {})
    assert not log.take_over("died") and not log.take_over("ran", -1) and not log.take_over("none", -1)
    assert log.take_over("died", -1) and log.create("died", {"target": "t"})


@pytest.mark.parametrize("shard", [1 << 22, 700])
def test_filter_adds_merges_and_lets_few_through(spark, tmp_path, shard):
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"))
    one, two = (M.Membership.create(spark, f"file://{tmp_path}/{n}", 4000, 0.01, shard) for n in "ab")
    assert one.contains(keys(0, 5), "key").where("maybe").count() == 0  # nothing added yet
    one.add(keys(0, 1500).union(keys(0, 1500)).union(spark.createDataFrame([(None,)], "key string")), "key")
    two.add(keys(1500, 3000), "key")
    two.add(keys(3000, 4000), "key")
    one.merge(two)
    again = M.Membership.open(spark, f"file://{tmp_path}/a")
    assert again.shape == one.shape and again.version() == 2
    assert again.contains(keys(0, 4000), "key").where("not maybe").count() == 0  # never no to what is there
    wrong = again.contains(keys(10_000, 40_000), "key").where("maybe").count() / 30_000
    assert 0 < wrong < 0.015
    got = again.unseen(keys(3500, 20_000).union(keys(3990, 4010)), keys(0, 4000), "key").collect()
    assert sorted(r["key"] for r in got) == sorted([f"k{i}" for i in range(4000, 20_000)] + [f"k{i}" for i in range(4000, 4010)])
    with pytest.raises(ValueError, match="merged"):
        one.merge(M.Membership.create(spark, f"file://{tmp_path}/c", 10, 0.5))


def test_error_rate_of_the_shape():
    shape = M.Shape(5_000_000, 0.001)
    assert shape.shards == 2 and shape.hashes == 10
    rng = np.random.default_rng(1)
    small = M.Shape(20_000, 0.001)
    bits = np.unpackbits(M._bitmap(small, rng.integers(-(2**63), 2**63, 20_000)))
    asked = bits[M.places(small, rng.integers(-(2**63), 2**63, 200_000))].all(axis=1).mean()
    assert asked < 0.0015
