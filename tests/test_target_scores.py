import numpy as np
import pandas as pd
import pytest

from barloom.operators import scores as S


def _plain(y, close, h):
    k, out = y.dropna(), {}
    ic = lambda s: abs(pd.concat([y, s], axis=1).dropna().rank().corr().iloc[0, 1])
    past = [ic(close.pct_change(n).shift(1)) for n in (1, 3, 12)]
    out.update(ic_median=np.median(past), leakage_proxy_score=ic(close.pct_change(1).shift(-1)) - past[0])
    half = len(k) // 2
    at = np.sort(k.unique())
    ks = max(abs((k[:half].to_numpy()[:, None] <= at).mean(0) - (k[half:].to_numpy()[:, None] <= at).mean(0)))
    score = 1 - 0.7 * y.isna().mean() - 0.3 * ks + 0.2 * min(0.5, out["ic_median"]) - 0.4 * (out["leakage_proxy_score"] > 0.2)
    if k.isin([0, 1]).all():
        p = k.mean()
        return out | {"class_ratio": max(p, 1 - p) / min(p, 1 - p), "health_score": score - 0.8 * abs(p - 0.5)}
    c = k - k.mean()
    out |= {"skew": (c**3).mean() / (c**2).mean() ** 1.5, "kurtosis": (c**4).mean() / (c**2).mean() ** 2 - 3, "acf_lagH": np.corrcoef(k[:-h], k[h:])[0, 1], "range_rel": np.ptp(k) / k.abs().mean()}
    return out | {"health_score": score - 0.1 * (abs(np.corrcoef(k[:-1], k[1:])[0, 1]) < 0.02)}


def test_target_scores_equal_the_formulas(spark):
    rng = np.random.default_rng(5)
    close = pd.Series(100 + rng.standard_normal(400).cumsum())
    values = close.pct_change().shift(-1) + 0.004 * pd.Series(rng.standard_normal(400))
    for y in (values, (close.shift(-3) > close).astype(float)):
        d = pd.DataFrame({"series_id": "a", "bar_idx": np.arange(400), "close": close, "y": y})
        got = S.target_scores(spark.createDataFrame(d), "y", 5).toPandas().iloc[0]
        for name, value in _plain(y, close, 5).items():
            assert got[name] == pytest.approx(value, abs=1e-9), name


def test_totals_in_buckets_are_those_of_the_whole(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from barloom.operators import scores as S

    rng = random.Random(5)
    x = [0.0, -0.0, 1e-301, 1.0, 1.0 + 2**-52, math.nextafter(2.0, 0), 2.0, -2.0, 1e300, -1e300] + [rng.choice([rng.uniform(100, 101), rng.gauss(0, 1), rng.gauss(0, 1e-9), 10 ** rng.uniform(-20, 20)]) for _ in range(3000)]
    d = spark.createDataFrame([("g", v) for v in sorted(set(x))], "g string, x double").withColumn("c", F.lit(1))
    rows = d.withColumn("b", S.value_bucket(F.col("x"))).orderBy("x").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(rows, rows[1:], strict=False))
    for down in (False, True):
        got = [r["n"] for r in S.running_totals(d, ["g"], "x", {"n": "c"}, down).orderBy(F.desc("x") if down else "x").collect()]
        assert got == list(range(1, len(rows) + 1))
