"""Features of bars, by family. Each function takes bars and returns series_id, bar_idx and its feature columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import ewm
from barloom.operators.exprs import KEYS, by_time, clip, cum, col, div, pct_change, roll, sliding, zero

#: Bars of five minutes in each horizon.
HORIZONS = {"4h": 48, "6h": 72, "12h": 144, "1d": 288, "2d": 576, "1w": 2016, "2w": 4032}
CHANNELS = (20, 48, 50, 72, 144, 288, 576, 4032)
DISTANCES = (48, 72, 144, 288, 576, 2016, 4032)
TRANSFORMED = ("dist_to_max_1w_pct", "dist_to_min_1w_pct", "dist_to_max_1d_pct", "rolling_std_5", "vol_sum_1d_cal", "vol_sum_1d_roll")


def hlc3() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def with_prices(bars: DataFrame) -> DataFrame:
    """Adds hlc3 and vwap (cumulative; gaps filled from before, then from after; hlc3 without volume)."""
    df = bars.withColumn("hlc3", hlc3())
    if "volume" not in bars.columns:
        return df.withColumn("vwap", F.col("hlc3"))
    raw = div(F.sum(F.col("hlc3") * F.col("volume")).over(cum()), F.nullif(F.sum("volume").over(cum()), F.lit(0.0)))
    df = df.withColumn("_v", raw).withColumn("_v", F.last("_v", ignorenulls=True).over(cum()))
    return df.withColumn("vwap", F.coalesce("_v", F.first("_v", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("_v")


def extremes(bars: DataFrame, bases: tuple[str, ...] = ("close", "hlc3", "vwap"), labels: tuple[str, ...] = tuple(HORIZONS)) -> DataFrame:
    """Distance to rolling extremes of close, hlc3 and vwap, and bars since the close's (the oldest of equal ones)."""
    wanted = [(base, label) for label in labels for base in bases if base == "close" or label not in ("1d", "1w")]
    prefix = {base: "" if base == "close" else f"{base}_" for base in bases}
    names = [f"{prefix[base]}dist_to_{k}_{label}_{u}" for base, label in wanted for k in ("max", "min") for u in ("pct", "abs")]
    names += [f"bars_since_{k}_{label}" for base, label in wanted if base == "close" for k in ("max", "min")]

    def fn(d: pd.DataFrame) -> dict:
        out = {}
        for base, label in wanted:
            x = d[base].to_numpy(float)
            for k, side in (("max", 1), ("min", -1)):
                best, at = ewm.rolling_extreme(x, HORIZONS[label], side > 0)
                off, p = side * (best - x), f"{prefix[base]}dist_to_{k}_{label}"
                out[f"{p}_abs"] = np.nan_to_num(off, nan=0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[f"{p}_pct"] = np.where((best == 0) | np.isnan(off), 0.0, off / best)
                if base == "close":
                    out[f"bars_since_{k}_{label}"] = np.where(at >= 0, np.arange(len(x)) - at, 0.0)
        return {n: pd.Series(out[n], index=d.index) for n in names}

    source = bars if set(bases) == {"close"} else with_prices(bars)
    return ewm.per_series(source.select(*KEYS, *bases), names, fn, halo=max(HORIZONS[label] for _, label in wanted) - 1)


def volume(bars: DataFrame) -> DataFrame:
    """Day totals (which look ahead within the day, by definition), their changes and weekly maximum, and rolling sums."""
    v = F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in bars.columns else F.lit(0.0)
    df = bars.select(*KEYS, F.date_trunc("day", "ts").alias("day"), v.alias("v"))
    daily = df.groupBy("series_id", "day").agg(F.round(F.sum("v"), 6).alias("total"))
    by_day = Window.partitionBy("series_id").orderBy("day")
    daily = daily.withColumns({"before": F.lag("total").over(by_day), "week_max": F.max("total").over(by_day.rowsBetween(-6, 0))})
    df = sliding(df, 288, {"_r": ("sum", F.col("v"))}).join(daily, ["series_id", "day"], "left").withColumn("_r", F.round("_r", 6))
    d, b, m, r = (F.col(c) for c in ("total", "before", "week_max", "_r"))
    return df.select(
        *KEYS, d.alias("vol_sum_1d_cal"), zero(d - b).alias("vol_sum_1d_change_abs"), zero(div(d - b, b)).alias("vol_sum_1d_change_pct"), m.alias("vol_sum_1w_max_cal"),
        zero(m - d).alias("vol_sum_to_1w_max_abs"), zero(div(m - d, m)).alias("vol_sum_to_1w_max_pct"), r.alias("vol_sum_1d_roll"),
        zero(r - F.lag(r).over(by_time())).alias("vol_sum_1d_roll_change_abs"), zero(pct_change(r)).alias("vol_sum_1d_roll_change_pct"),
    )


def calendar(bars: DataFrame) -> DataFrame:
    ts, day = F.col("ts"), F.to_date("ts")
    minute = F.hour(ts) * 60 + F.minute(ts)
    dow = F.weekday(ts)
    flag = lambda c: c.cast("int")
    quarter = F.date_trunc("quarter", ts)
    return bars.select(
        *KEYS, F.sin(2 * math.pi * minute / 1440).alias("tod_sin"), F.cos(2 * math.pi * minute / 1440).alias("tod_cos"), F.sin(2 * math.pi * dow / 7).alias("dow_sin"), F.cos(2 * math.pi * dow / 7).alias("dow_cos"),
        flag(dow >= 5).alias("is_weekend"), (F.hour(ts) / 23.0).alias("hour_norm"), flag(F.dayofmonth(ts) == 1).alias("is_month_start"), flag(F.last_day(ts) == day).alias("is_month_end"),
        flag(F.to_date(quarter) == day).alias("is_quarter_start"), flag(F.last_day(F.add_months(quarter, 2)) == day).alias("is_quarter_end"),
    )


def momentum(bars: DataFrame) -> DataFrame:
    """Changes of close and volume; five-bar mean and deviation, whose first four rows take the fifth's value."""
    c = F.col("close")
    full = F.count("close").over(roll(5)) >= 5
    ahead = Window.partitionBy("series_id").orderBy(F.col("bar_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumns({"_m": F.when(full, F.avg("close").over(roll(5))), "_s": F.when(full, F.stddev_samp("close").over(roll(5)))})
    v = zero(pct_change("volume")) if "volume" in bars.columns else F.lit(0.0)
    return df.select(
        *KEYS, zero(pct_change("close")).alias("pct_change"), zero(c - F.lag(c, 3).over(by_time())).alias("momentum_3"), F.last("_m", ignorenulls=True).over(ahead).alias("rolling_mean_5"),
        F.last("_s", ignorenulls=True).over(ahead).alias("rolling_std_5"), v.alias("volume_change"),
    )


def transforms(values: DataFrame, bases: tuple[str, ...]) -> DataFrame:
    """First difference, relative change and smoothed velocity (half-life 30) of each base column."""
    names = [f"{b}{s}" for b in bases for s in ("_diff1", "_pct1", "_vel_ema")]

    def fn(d: pd.DataFrame) -> dict:
        out = {}
        for b in bases:
            x = d[b].astype(float)
            step = x.diff()
            out[f"{b}_diff1"] = step.fillna(0.0)
            out[f"{b}_pct1"] = (x.ffill() / x.ffill().shift() - 1).replace([np.inf, -np.inf], np.nan).fillna(0.0)
            out[f"{b}_vel_ema"] = ewm.ewm_mean(step, ewm.halflife(30)).fillna(0.0)
        return out

    return ewm.per_series(values.select(*KEYS, *bases), names, fn, halo=2 + ewm.memory(ewm.halflife(30)))


def native_transforms(bars: DataFrame) -> DataFrame:
    joined = extremes(bars, ("close",), ("1d", "1w")).join(volume(bars), list(KEYS)).join(momentum(bars), list(KEYS))
    return transforms(joined, TRANSFORMED)


def channels(bars: DataFrame, windows: tuple[int, ...] = CHANNELS) -> DataFrame:
    """Where close stands in Bollinger and Donchian bands, and its distance to the average."""
    names = [f"close_{k}" for n in windows for k in (f"pos_bb_w{n}_k2", f"z_bb_w{n}_k2", f"pos_dc_w{n}", f"dist_sma_std_w{n}")]

    def fn(d: pd.DataFrame) -> dict:
        out, c = {}, d["close"].astype(float)
        held = lambda x, k: x.clip(-k, k).fillna(0.0)
        start = c.first_valid_index()
        moved = c - (0.0 if start is None else c[start])  # sums of small numbers: a level far from 0 would cancel their last places
        for n in windows:
            extreme = lambda k, largest, n=n: pd.Series(ewm.rolling_extreme(d[k].to_numpy(float), n, largest)[0], index=d.index)
            full = moved.rolling(n).count() >= n
            known = moved.fillna(0.0).to_numpy()
            mean = pd.Series(ewm.rolling_sum(known, n) / n, index=d.index).where(full)
            spread = (ewm.rolling_sum(known * known, n) / n - mean * mean).clip(lower=0)
            flat = extreme("close", True) == extreme("close", False)
            off, sd = moved - mean, np.sqrt(spread.where(~flat)).replace(0, np.nan)
            hi, lo = (extreme(k, largest).where(d[k].rolling(n).count() >= n) for k, largest in (("high", True), ("low", False)))
            out[f"close_pos_bb_w{n}_k2"], out[f"close_z_bb_w{n}_k2"] = held(off / (4 * sd), 5), held(off / (2 * sd), 10)
            out[f"close_pos_dc_w{n}"] = held((c - (hi + lo) / 2) / (hi - lo).replace(0, np.nan), 5)
            out[f"close_dist_sma_std_w{n}"] = held(off / sd, 10)
        return out

    return ewm.per_series(bars.select(*KEYS, "high", "low", "close"), names, fn, halo=max(windows) - 1)


def channels_smoothed(bars: DataFrame, windows: tuple[int, ...] = CHANNELS) -> DataFrame:
    """Where close stands in Keltner and ATR bands, and its distance to the smoothed average."""
    names = [f"close_{k}" for n in windows for k in (f"pos_kc_w{n}_m2", f"dist_ema_atr_w{n}", f"pos_atrband_w{n}_m2")]

    def fn(d: pd.DataFrame) -> dict:
        out, c, tr = {}, d["close"], ewm.true_range(d)
        for n in windows:
            atr, off = ewm.ewm_mean(tr, ewm.span(n)).replace(0, np.nan), c - ewm.ewm_mean(c, ewm.span(n))
            out[f"close_pos_kc_w{n}_m2"] = (off / (4 * atr)).clip(-5, 5).fillna(0.0)
            out[f"close_dist_ema_atr_w{n}"] = (off / atr).clip(-10, 10).fillna(0.0)
            # without a move the distance is 0, whatever the last places of the mean say
            out[f"close_pos_atrband_w{n}_m2"] = ((c - c.rolling(n).mean()).where(c.rolling(n).max() > c.rolling(n).min(), 0.0) / (4 * atr)).clip(-5, 5).fillna(0.0)
        return out

    return ewm.per_series(bars.select(*KEYS, "high", "low", "close"), names, fn, halo=ewm.memory(ewm.span(max(windows))))


def other_distances(bars: DataFrame, windows: tuple[int, ...] = DISTANCES) -> DataFrame:
    """Distance of hlc3 and vwap to their smoothed selves, in smoothed true ranges."""
    names = [f"{b}_dist_ema_atr_w{n}" for b in ("hlc3", "vwap") for n in windows]

    def fn(d: pd.DataFrame) -> dict:
        out, tr = {}, ewm.true_range(d)
        for n in windows:
            atr = ewm.ewm_mean(tr, ewm.span(n)).replace(0, np.nan)
            for b in ("hlc3", "vwap"):
                out[f"{b}_dist_ema_atr_w{n}"] = ((d[b] - ewm.ewm_mean(d[b], ewm.span(n))) / atr).clip(-10, 10).fillna(0.0)
        return out

    return ewm.per_series(with_prices(bars).select(*KEYS, "high", "low", "close", "hlc3", "vwap"), names, fn, halo=ewm.memory(ewm.span(max(windows))))


#: Of an RSI from 0 to 100: where prices stand still, what is below is rounding and no spread.
LEAST_SPREAD = 1e-4


def rsi_regime(bars: DataFrame, length: int = 14, adx_length: int = 14, w: int = 576, k: int = 3) -> DataFrame:
    """RSI against its own history, weighed by trend strength: scores, and crossings of +-0.5."""
    tag = f"l{length}_a{adx_length}_w{w}_k{k}"
    names = [f"rsi_z_l{length}_w{w}", f"rsi_slope_z_l{length}_w{w}_k{k}", f"rsi_rps_regime_a{adx_length}", f"rsi_rps_{tag}", f"rsi_rps_long_{tag}", f"rsi_rps_short_{tag}"]

    def fn(d: pd.DataFrame) -> dict:
        r, least = ewm.rsi(d["close"], length), max(length, w // 4)
        history, step = r.rolling(w, min_periods=least), r.diff(k)
        some = lambda sd: sd.where(sd > LEAST_SPREAD)
        z = (r - history.mean()) / some(history.std(ddof=0))
        slope = (step / some(step.rolling(w, min_periods=least).std(ddof=0))).fillna(0.0)
        trend = ((ewm.adx(d, adx_length) - 20) / 5).clip(0, 1)
        wide = r.rolling(w, min_periods=max(length, w // 2))
        lo, hi = wide.quantile(0.2), wide.quantile(0.8)
        place = (2 * r - lo - hi) / (hi - lo).replace(0, np.nan)
        score = np.tanh(0.75 * ((2 * trend - 1) * place + trend * 0.5 * slope)).fillna(0.0)
        before = score.shift()
        long_, short = (score > 0.5) & (before <= 0.5), (score < -0.5) & (before >= -0.5)
        return dict(zip(names, (z.fillna(0.0), slope, trend.fillna(0.0), score, long_.astype(float), short.astype(float)), strict=True))

    # three smoothings in a row and two windows: each adds its memory
    return ewm.per_series(bars.select(*KEYS, "high", "low", "close"), names, fn, halo=3 * ewm.memory(1 / max(length, adx_length)) + 2 * w + k)


__all__ = ["calendar", "channels", "channels_smoothed", "col", "extremes", "momentum", "native_transforms", "other_distances", "rsi_regime", "transforms", "volume", "with_prices"]
