import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import bars as B
from barloom.operators import ewm
from barloom.operators import features as FT
from barloom.operators import targets as T


def _bars(spark, close, volume=None):
    n = len(close)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=5 * k), k, float(c), float(c) + 1, float(c) - 1, float(c), float(volume[k]) if volume is not None else 1.0) for k, c in enumerate(close)]
    assert n
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, bar_idx long, open double, high double, low double, close double, volume double")


def test_gap_fill_flags_and_flat_candles(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0, 1.0, 2.0, 0.5, 1.5, 10.0), ("a", t0 + dt.timedelta(minutes=20), 3.0, 4.0, 2.0, 3.5, 5.0)]
    got = B.fill(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double")).orderBy("bar_idx").collect()
    assert [r["gap_len"] for r in got] == [0, 1, 2, 3, 0]
    assert [r["close"] for r in got] == [1.5, 1.5, 1.5, 1.5, 3.5]
    assert got[1]["open"] == got[1]["high"] == 1.5 and got[1]["volume"] == 0.0 and got[1]["is_imputed_price"]


def test_sliding_extremes_equal_pandas(spark):
    rng = np.random.default_rng(0)
    close = rng.integers(1, 20, 400)
    got = FT.extremes(_bars(spark, close), ("close",), ("4h", "6h")).toPandas().sort_values("bar_idx")
    s = pd.Series(close, dtype=float)
    for label, n in (("4h", 48), ("6h", 72)):
        mx = s.rolling(n, min_periods=1).max()
        assert np.allclose(got[f"dist_to_max_{label}_abs"], mx - s)
        since = s.rolling(n, min_periods=1).apply(lambda x: len(x) - 1 - np.argmax(x), raw=True)
        assert np.allclose(got[f"bars_since_max_{label}"], since)


def test_channels_equal_pandas_and_flat_series_are_zero(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(size=200).cumsum()
    got = FT.channels(_bars(spark, close), (20,)).toPandas().sort_values("bar_idx")
    s = pd.Series(close)
    sd = s.rolling(20).std(ddof=0)
    assert np.allclose(got["close_z_bb_w20_k2"], ((s - s.rolling(20).mean()) / (2 * sd)).clip(-10, 10).fillna(0))
    ema = s.ewm(span=20, adjust=False).mean()
    tr = pd.concat([pd.Series(2.0, s.index), (s + 1 - s.shift()).abs(), (s - 1 - s.shift()).abs()], axis=1).max(axis=1)
    atr = tr.ewm(span=20, adjust=False).mean()
    smoothed = FT.channels_smoothed(_bars(spark, close), (20,)).toPandas().sort_values("bar_idx")
    assert np.allclose(smoothed["close_dist_ema_atr_w20"], ((s - ema) / atr).clip(-10, 10).fillna(0))
    flat = FT.channels(_bars(spark, [5.0] * 50), (20,)).toPandas()
    assert (flat["close_z_bb_w20_k2"] == 0).all()


def test_future_tail_is_zero_and_margin_tail_is_null(spark):
    b = _bars(spark, np.arange(1, 41))
    f = T.future(b).toPandas().sort_values("bar_idx")
    assert f["future_up"].tolist() == [1] * 39 + [0] and f["future_up_20"].sum() == 20
    m = T.margin(b).toPandas().sort_values("bar_idx")
    assert m["up_margin_H12_k075"].isna().sum() == 12


def test_peaks_and_valleys_alternate(spark):
    close = 10 + np.sin(np.arange(300) / 10)
    d = spark.createDataFrame(pd.DataFrame({"series_id": "s", "bar_idx": np.arange(300), "close": close}))
    sides = [r["side"] for r in T.extremes_of(d, 50, 1.0).orderBy("place").collect()]
    assert len(sides) > 5 and all(a != b for a, b in zip(sides, sides[1:]))


def test_ewm_std_against_recurrence():
    x = pd.Series(np.random.default_rng(2).normal(size=50))
    a = ewm.halflife(60)
    m, v, w2, out = x[0], 0.0, 1.0, [np.nan]
    for t in x[1:]:
        d = t - m
        m += a * d
        v = (1 - a) * (v + a * d * d)
        w2 = (1 - a) ** 2 * w2 + a * a
        out.append(np.sqrt(v / (1 - w2)))
    assert np.allclose(ewm.ewm_std(x, 60)[1:], out[1:])


@pytest.mark.parametrize("name", ["history_by_target", "metrics_classification", "splits_walk_forward", "weights_updated"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from barloom import plans

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    a, b = plans.QUERIES[name](spark, d).toPandas(), con.sql(plans.ORACLES[name]).df()
    b = b[list(a.columns)]
    key = [c for c, t in a.dtypes.items() if t == object or "int" in str(t)]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in a)


@pytest.mark.parametrize("family", ["extremes", "channels", "channels_smoothed", "other_distances", "native_transforms", "rsi_regime"])
def test_blocks_of_a_series_give_what_the_whole_gives(spark, monkeypatch, family):
    close = 100 + np.random.default_rng(4).normal(size=3000).cumsum()
    b = _bars(spark, close)
    small = {"channels": ((20, 50),), "channels_smoothed": ((20, 50),), "other_distances": ((48,),), "extremes": (("close",), ("4h", "6h"))}.get(family, ())
    make = lambda: getattr(FT, family)(b, *small).toPandas().sort_values("bar_idx").reset_index(drop=True)
    whole = make()
    monkeypatch.setattr(ewm, "BLOCK_ROWS", 500)
    cut = make()
    assert len(cut) == 3000
    for c in whole.columns[2:]:
        assert np.allclose(whole[c], cut[c], rtol=1e-9, atol=1e-9), c


def test_rolling_extreme_against_every_window():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 48):
        x = rng.integers(0, 6, 200).astype(float)
        x[:3] = np.nan
        for largest in (True, False):
            value, at = ewm.rolling_extreme(x, n, largest)
            for t in range(200):
                w = x[max(0, t - n + 1) : t + 1]
                if np.isnan(w).all():
                    assert np.isnan(value[t]) and at[t] == -1
                else:
                    k = np.nanargmax(w) if largest else np.nanargmin(w)
                    assert value[t] == w[k] and at[t] == max(0, t - n + 1) + k


def test_staged_indicators_equal_pandas(spark):
    from barloom.operators import staged

    close = 100 + np.random.default_rng(7).normal(size=120).cumsum()
    got = staged.indicators(_bars(spark, close)).toPandas().sort_values("bar_idx").reset_index(drop=True)
    c = pd.Series(close)
    line = c.rolling(14).apply(lambda y: np.polyval(np.polyfit(np.arange(14), y, 1), 13), raw=True)
    ahead = c.rolling(9).apply(lambda y: np.polyval(np.polyfit(np.arange(9), y, 1), 9), raw=True)
    wma = lambda x, n: x.rolling(n).apply(lambda y: y @ np.arange(1, n + 1) / (n * (n + 1) / 2), raw=True)
    want = {
        "overlap_linreg": line, "momentum_cfo": 100 * (c - ahead) / c, "overlap_hma": wma(2 * wma(c, 5) - wma(c, 10), 3), "statistics_skew": c.rolling(30).skew(), "statistics_kurtosis": c.rolling(30).kurt(),
        "statistics_mad": c.rolling(30).apply(lambda y: np.abs(y - y.mean()).mean(), raw=True), "momentum_cti": c.rolling(12).corr(pd.Series(np.arange(120.0))), "overlap_trima": c.rolling(6).mean().rolling(6).mean(),
        "candles_cdl_z_close": (c - c.rolling(30).mean()) / c.rolling(30).std(),
    }
    for k, x in want.items():
        assert np.allclose(got[f"ta_{k}"], x.fillna(0.0), atol=1e-6), k


def test_correlation_of_constants_is_null(spark):
    from barloom.operators import scores as S

    d = spark.range(60).selectExpr("'s' as series_id", "id as bar_idx", "1.0D as a", "cast(id as double) as b", "cast(id % 2 as double) as y")
    got = {r["feature"]: r for r in S.affinity(d, ["a", "b"], "y").collect()}
    assert got["a"]["pearson"] is None and got["b"]["pearson"] is not None


def _events_at_zero(path, n=400, zeros=(60, 61, 130, 250)):
    """Events of one type, one for each bar, with prices of 0 at some bars."""
    import duckdb

    rng = np.random.default_rng(5)
    value = np.round(50 + rng.normal(0, 1, n).cumsum(), 2)
    value[list(zeros)] = 0.0
    d = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(5 * np.arange(n) + 1, "min"), "user_id": 1, "event_type": "view", "value": value, "props": "{}"})
    duckdb.connect().sql(f"copy (select * replace (ts::timestamp as ts) from d) to '{path}/events.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["pv_artifact", "pv_features", "targets_pv_d200_t2_family", "targets_margin"])
def test_a_price_of_zero_gives_what_sql_gives(spark, tmp_path, name):
    import duckdb

    from barloom import plans

    d = _events_at_zero(tmp_path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{d}/events.parquet')")
    a, b = plans.QUERIES[name](spark, d).toPandas(), con.sql(plans.ORACLES[name]).df()
    a, b = (x[list(a.columns)].sort_values("bar_idx", ignore_index=True) for x in (a, b))
    assert len(a) == len(b) == 400 and [c for c in a if not ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all()] == []


def test_margin_passes_infinite_returns_by_as_pandas_does(spark):
    close = 50 + np.random.default_rng(6).normal(0, 1, 200).cumsum()
    close[[40, 41, 90]] = 0.0
    c = pd.Series(close)
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = 0.75 * np.sqrt(12) * np.log(c).diff().ewm(halflife=60, adjust=False).std().fillna(0.0)
        r = np.log(c.shift(-12)) - np.log(c)
    got = T.margin(_bars(spark, close)).toPandas().sort_values("bar_idx", ignore_index=True)
    want = pd.Series(np.where(r > tau, 1.0, np.where(r < -tau, -1.0, 0.0))).where(r.notna())
    assert got["updown_margin_H12_k075"].astype(float).equals(want) and (want[[28, 40]] == [-1, 1]).all()
    assert got["up_margin_H12_k075"].astype(float).equals((want == 1).astype(float).where(r.notna()))


def test_spread_deals_more_parts_the_more_rows_there_are(spark, monkeypatch):
    from barloom.plans import base

    monkeypatch.setattr(base, "SPREAD_ROWS", 10, raising=False)
    assert base.spread(spark.range(100)).rdd.getNumPartitions() == 10 and base.spread(spark.range(5)).rdd.getNumPartitions() == 4
