"""Recurrences in blocks against plain loops over whole series."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import features as FT
from barloom.operators import scan
from barloom.operators import targets as T
from barloom.operators import technical as TA

N = 7000


def walk(n, seed, gap=0):
    rng = np.random.default_rng(seed)
    step = rng.normal(0, 0.3, n)
    step[n // 3 : n // 3 + 400] = 0  # a long stretch that stands still
    c = 100 + np.cumsum(step)
    o = np.r_[c[0], c[:-1]]
    flat = step == 0
    h, l = np.maximum(o, c) + ~flat * rng.random(n) * 0.2, np.minimum(o, c) - ~flat * rng.random(n) * 0.2  # noqa: E741
    d = pd.DataFrame({"open": o, "high": h, "low": l, "close": c, "volume": rng.integers(1, 50, n).astype(float)})
    d.loc[: gap - 1, ["open", "high", "low", "close"]] = np.nan
    if gap:
        d.loc[: gap - 1, "volume"] = 0.0
    return d


@pytest.fixture(scope="module")
def series():
    return {"long": walk(N, 1), "late": walk(N, 2, gap=3), "short": walk(500, 3, gap=1)}


@pytest.fixture(scope="module")
def many(spark, series):
    whole = pd.concat([d.assign(series_id=k, bar_idx=np.arange(len(d))) for k, d in series.items()])
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in whole[["series_id", "bar_idx", "open", "high", "low", "close", "volume"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "series_id string, bar_idx long, open double, high double, low double, close double, volume double").repartition(4).cache()


def by_series(df):
    return {k: g.sort_values("bar_idx").reset_index(drop=True) for k, g in df.toPandas().groupby("series_id")}


def loops(d):
    """Plain row loops over the bars that are known."""
    d = d.dropna().reset_index(drop=True)
    o, h, l, c = (d[k].to_numpy() for k in ("open", "high", "low", "close"))  # noqa: E741
    n, out = len(c), {}
    kama, vidya, ssf, ha, decay = c.copy(), c.copy(), c.copy(), np.empty(n), c.copy()
    q = np.exp(-np.sqrt(2) * np.pi / 10)
    c2, c3 = 2 * q * np.cos(np.sqrt(2) * np.pi / 10), -q * q
    ha[0] = (o[0] + c[0]) / 2
    for i in range(1, n):
        ha[i] = (ha[i - 1] + (o[i - 1] + h[i - 1] + l[i - 1] + c[i - 1]) / 4) / 2
        decay[i] = max(c[i], decay[i - 1] - 0.2, 0.0)
        if i > 1:
            ssf[i] = (1 - c2 - c3) * c[i] + c2 * ssf[i - 1] + c3 * ssf[i - 2]
        if i >= 10:
            moved = np.abs(np.diff(c[i - 10 : i + 1])).sum()
            share = 0.0 if moved == 0 else (abs(c[i] - c[i - 10]) / moved * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            kama[i] = kama[i - 1] + share * (c[i] - kama[i - 1])
        if i >= 14:
            step = np.diff(c[i - 14 : i + 1])
            k = 0.0 if np.abs(step).sum() == 0 else abs(step.sum()) / np.abs(step).sum() * 2 / 15
            vidya[i] = k * c[i] + (1 - k) * vidya[i - 1]
    out |= {"ta_overlap_kama": kama, "ta_overlap_vidya": vidya, "ta_overlap_ssf": ssf, "ta_candles_ha_open": ha, "ta_trend_decay": decay}
    f, v, a, hw = c[0], 0.0, 0.0, np.empty(n)
    for i in range(n):
        g = 0.8 * (f + v + a / 2) + 0.2 * c[i]
        w = 0.9 * (v + a) + 0.1 * (g - f)
        a, f, v = 0.9 * a + 0.1 * (w - v), g, w
        hw[i] = f + v + a / 2
    out["ta_overlap_hwma"] = hw
    up, af, ext, sar, ps = h[1] >= h[0], 0.02, None, None, np.zeros(n)
    ext, sar = (h[0], l[0]) if up else (l[0], h[0])
    for i in range(1, n):
        sar += af * (ext - sar)
        if (l[i] < sar) if up else (h[i] > sar):
            up, sar, ext, af = not up, ext, (l[i] if up else h[i]), 0.02
        elif (h[i] > ext) if up else (l[i] < ext):
            ext, af = (h[i] if up else l[i]), min(0.2, af + 0.02)
        ps[i] = sar
    out["ta_trend_psar"] = ps
    md = c.copy()
    for i in range(1, n):
        md[i] = md[i - 1] + (c[i] - md[i - 1]) / (10 * max(c[i] / md[i - 1], 1e-3) ** 4)
    out["ta_overlap_mcgd"] = md
    return out


def test_indicators_in_blocks_equal_loops_and_one_block(many, series):
    in_blocks, at_once = (by_series(TA.recursive_indicators(many, rows)) for rows in (1, 10**6))  # 1: as small as the halo allows
    assert N > 3 * TA.HALO
    for k, d in series.items():
        names = [c for c in in_blocks[k].columns if c.startswith("ta_")]
        known = d["close"].notna().to_numpy()
        for n in names:
            got, want = in_blocks[k][n].to_numpy(), at_once[k][n].to_numpy()
            assert np.allclose(got, want, rtol=1e-9, atol=1e-7 if "ado" in n or "obv" in n else 1e-9), (k, n, np.abs(got - want).max())
        for n, want in loops(d).items():
            assert np.allclose(in_blocks[k][n].to_numpy()[known], want, rtol=1e-9, atol=1e-9), (k, n)


def test_nothing_stays_0_after_a_leading_gap(many, series):
    got = by_series(TA.recursive_indicators(many))["late"]
    late = got.iloc[-3000:]
    dead = [c for c in got.columns if c.startswith("ta_") and (late[c] == 0).all()]
    assert not [c for c in dead if "squeeze" not in c and "amat" not in c], dead
    bands = by_series(FT.channels(many, (20, 48, 288)))
    assert not [c for c in bands["late"].columns if c.startswith("close_") and (bands["late"][c].iloc[-100:] == 0).all()]
    # what the gap doesn't reach equals the same bars without it
    alone = many.where("series_id = 'late' and bar_idx >= 3").withColumn("bar_idx", many["bar_idx"] - 3)
    same = by_series(FT.channels(alone, (20, 48)))["late"]
    for c in same.columns[2:]:
        assert np.allclose(same[c].to_numpy(), by_series(FT.channels(many.where("series_id = 'late'"), (20, 48)))["late"][c].to_numpy()[3:], atol=1e-9), c


@pytest.mark.parametrize(("distance", "threshold"), [(1000, 2.0), (60, 1.0), (5000, 50.0)])
def test_peaks_and_valleys_in_blocks_equal_those_of_one(many, distance, threshold):
    at_once = by_series(T.peaks_and_valleys(many, distance, threshold))
    for rows in (1000, 97):
        in_blocks = by_series(T.peaks_and_valleys(many, distance, threshold, rows))
        for k in at_once:
            pd.testing.assert_frame_equal(in_blocks[k], at_once[k])
    if threshold < 50:
        assert at_once["long"]["peak"].sum() > 3


def plain_artifact(close, distance, threshold):
    """(place, side) by a loop over the filled series."""
    x = pd.Series(close).ffill().bfill().to_numpy()
    out, hi, lo, side = [], 0, 0, 0
    for i in range(1, len(x)):
        hi, lo = (i if x[i] > x[hi] else hi), (i if x[i] < x[lo] else lo)
        fall, rise = (x[hi] - x[i]) / x[hi] * 100 >= threshold, (x[i] - x[lo]) / x[lo] * 100 >= threshold
        if side >= 0 and hi < i and (fall or (i - hi >= distance and x[i] < x[hi])):
            out.append((hi, 1))
            side, hi, lo = -1, i, i
        elif side <= 0 and lo < i and (rise or (i - lo >= distance and x[i] > x[lo])):
            out.append((lo, -1))
            side, hi, lo = 1, i, i
    return out


def test_extremes_equal_a_loop_with_gaps_inside(spark):
    c = walk(3000, 5, gap=40)["close"].to_numpy().copy()
    rng = np.random.default_rng(6)
    for _ in range(40):
        k = rng.integers(50, 2900)
        c[k : k + rng.integers(1, 60)] = np.nan
    d = spark.createDataFrame([("s", i, None if np.isnan(x) else float(x)) for i, x in enumerate(c)], "series_id string, bar_idx long, close double")
    for rows in (None, 64):
        got = [(r["place"], r["side"]) for r in T.extremes_of(d, 30, 1.0, rows).collect()]
        assert sorted(got) == sorted(plain_artifact(c, 30, 1.0))


def test_totals_and_states_that_never_forget(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-5, 6, 1000).astype(float)
    rows = [(s, i, None if s == 1 and i < 30 or i % 50 == 7 else float(v)) for s in (1, 2) for i, v in enumerate(x[: 1000 if s == 1 else 130])]
    d = spark.createDataFrame(rows, "series_id long, bar_idx long, x double")
    got = by_series(scan.sums(d, {"total": "x"}, rows=64))
    for s, g in got.items():
        own = pd.Series([v for k, _, v in rows if k == s], dtype=float)
        want = own.cumsum().ffill()
        assert np.allclose(g["total"].to_numpy(float), want.to_numpy(float), equal_nan=True)

    def run(arrays, state):  # adds to a counter whose parity decides: no guess is ever right
        (v,) = arrays
        s, out = (state[0] if state else 0.0), np.empty(len(v))
        for i, y in enumerate(v):
            s += 1 if (y > 0) == (s % 2 == 0) else 2
            out[i] = s
        return [out], [s]

    count = scan.Recurrence(("s",), lambda b: (b["x"].to_numpy(float),), run, 1)
    in_blocks, at_once = (by_series(scan.scanned(d, ["s"], [count], 8, rows=r)) for r in (128, None))
    for s in at_once:
        pd.testing.assert_frame_equal(in_blocks[s], at_once[s])


def test_no_rows(spark):
    assert scan.scanned(spark.createDataFrame([], "series_id string, bar_idx long, close double"), ["s"], [scan.Recurrence(("s",), lambda b: (np.ones(len(b)),) * 3)], 0).count() == 0
