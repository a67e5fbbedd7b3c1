"""Technical indicators, from their public definitions. Each is named ta_<category>_<indicator>[_<output>].

Windowed ones are columns over one window order; those that follow a recurrence are computed per series in pandas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import ewm
from barloom.operators.exprs import KEYS, by_time, roll, zero
from barloom.operators.scan import Recurrence, scanned, sums
from barloom.operators.staged import fitted


def _sma(x, n: int) -> Column:
    return F.when(F.count(x).over(roll(n)) >= n, F.avg(x).over(roll(n)))


def _lag(x, k: int = 1) -> Column:
    return F.lag(x, k).over(by_time())


def window_indicators(bars: DataFrame) -> DataFrame:
    o, h, l, c, v = (F.col(k) for k in ("open", "high", "low", "close", "volume"))  # noqa: E741
    typical, td = (h + l + c) / 3, F.try_divide
    change = c - _lag(c)
    clv = F.coalesce(td(2 * c - h - l, h - l), F.lit(0.0))
    df = bars.withColumns({
        "hl2": (h + l) / 2, "hlc3": typical, "ohlc4": (o + h + l + c) / 4, "_d": change, "_clv": clv, "_tp": typical, "_up": F.greatest(change, F.lit(0.0)), "_dn": F.greatest(-change, F.lit(0.0)),
        "_pc": _lag(c), "_tr": F.greatest(h - l, F.abs(h - _lag(c)), F.abs(l - _lag(c))), "_vp": F.abs(h - _lag(l)), "_vm": F.abs(l - _lag(h)), "_dtp": typical - _lag(typical),
    })
    full = lambda n, x: F.when(F.count("close").over(roll(n)) >= n, x)
    mx, mn = (lambda n: F.max("high").over(roll(n))), (lambda n: F.min("low").over(roll(n)))
    s = lambda x, n: F.sum(x).over(roll(n))
    out = {
        "overlap_hl2": F.col("hl2"), "overlap_hlc3": F.col("hlc3"), "overlap_ohlc4": F.col("ohlc4"), "overlap_wcp": (h + l + 2 * c) / 4,
        "overlap_sma": _sma("close", 10), "overlap_midpoint": full(2, (F.max("close").over(roll(2)) + F.min("close").over(roll(2))) / 2), "overlap_midprice": full(2, (mx(2) + mn(2)) / 2),
        "overlap_vwma": full(10, td(s(c * v, 10), s(v, 10))), "overlap_wma": full(10, sum((10 - k) * _lag(c, k) if k else 10 * c for k in range(10)) / 55),
        "momentum_mom": c - _lag(c, 10), "momentum_roc": 100 * td(c - _lag(c, 10), _lag(c, 10)), "momentum_willr": full(14, 100 * (td(c - mn(14), mx(14) - mn(14)) - 1)),
        "momentum_bias": td(c, _sma("close", 26)) - 1, "momentum_bop": td(c - o, h - l), "momentum_ao": _sma("hl2", 5) - _sma("hl2", 34), "momentum_slope": change,
        "momentum_psl": full(12, 100 * F.avg((F.col("_d") > 0).cast("int")).over(roll(12))), "momentum_er": td(F.abs(c - _lag(c, 10)), s(F.abs("_d"), 10)),
        "momentum_cmo_sum": 100 * td(s("_up", 14) - s("_dn", 14), s("_up", 14) + s("_dn", 14)), "momentum_stoch_k": full(14, 100 * td(c - mn(14), mx(14) - mn(14))),
        "momentum_brar_br": 100 * td(s(F.greatest(h - F.col("_pc"), F.lit(0.0)), 26), s(F.greatest(F.col("_pc") - l, F.lit(0.0)), 26)), "momentum_brar_ar": full(26, 100 * td(s(h - o, 26), s(o - l, 26))),
        "trend_increasing": (change > 0).cast("double"), "trend_decreasing": (change < 0).cast("double"), "trend_qstick": _sma(c - o, 10),
        "trend_vhf": full(28, td(F.max("close").over(roll(28)) - F.min("close").over(roll(28)), s(F.abs("_d"), 28))), "trend_vortex_p": td(s("_vp", 14), s("_tr", 14)), "trend_vortex_m": td(s("_vm", 14), s("_tr", 14)),
        "trend_aroon_up": full(15, 100 * (1 - (F.col("bar_idx") - F.max_by("bar_idx", F.struct("high", "bar_idx")).over(roll(15))) / 14.0)), "trend_ttm": (c > _sma("hl2", 6)).cast("double"),
        "statistics_zscore": td(c - _sma("close", 30), full(30, F.stddev_samp("close").over(roll(30)))), "statistics_variance": full(30, F.var_samp("close").over(roll(30))), "statistics_stdev": full(30, F.stddev_samp("close").over(roll(30))),
        "statistics_median": full(30, F.percentile("close", 0.5).over(roll(30))), "statistics_quantile": full(30, F.percentile("close", 0.25).over(roll(30))),
        "volume_pvol": c * v, "volume_cmf": full(20, td(s(F.col("_clv") * v, 20), s(v, 20))), 
        "volume_mfi": 100 * td(s(F.when(F.col("_dtp") > 0, F.col("_tp") * v).otherwise(0.0), 14), s(F.when(F.col("_dtp") != 0, F.col("_tp") * v).otherwise(0.0), 14)),
        "candles_cdl_doji": (F.abs(c - o) < 0.1 * full(10, F.avg(h - l).over(roll(10)))).cast("double"), "candles_cdl_inside": ((h < _lag(h)) & (l > _lag(l))).cast("double"),
    }
    return df.select(*KEYS, *[zero(x).alias(f"ta_{k}") for k, x in out.items()])


def cumulative_indicators(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Totals from each series' start, in blocks of a series (rows: their size)."""
    h, l, c, v = (F.col(k) for k in ("high", "low", "close", "volume"))  # noqa: E741
    clv, before = F.coalesce(F.try_divide(2 * c - h - l, h - l), F.lit(0.0)), _lag(c)
    steps = {"volume_ad": clv * v, "volume_obv": F.signum(c - before) * v, "volume_pvt": 100 * F.try_divide(c - before, before) * v}
    totals = sums(bars.select(*KEYS, *[x.alias(f"_{k}") for k, x in steps.items()]), {f"ta_{k}": f"_{k}" for k in steps}, rows)
    return totals.select(*KEYS, *[zero(f"ta_{k}").alias(f"ta_{k}") for k in steps])


WINDOW_BEFORE = """,
stepped as (select *, (high + low) / 2 as hl2, (high + low + close) / 3 as hlc3, close - pc as d, coalesce((2 * close - high - low) / nullif(high - low, 0), 0.0) as clv,
   greatest(high - low, abs(high - pc), abs(low - pc)) as tr, abs(high - pl) as vp, abs(low - ph) as vm, (high + low + close) / 3 - (ph + pl + pc) / 3 as dtp
 from (select *, lag(close) over w as pc, lag(low) over w as pl, lag(high) over w as ph from bars window w as (partition by series_id order by bar_idx)))"""


def window_sql() -> dict[str, str]:
    w = "partition by series_id order by bar_idx"
    r = lambda f, n: f"{f} over ({w} rows {n - 1} preceding)" if n else f"{f} over ({w} rows unbounded preceding)"
    full = lambda n, x: f"case when {r('count(close)', n)} >= {n} then {x} end"
    sma = lambda x, n: f"case when {r(f'count({x})', n)} >= {n} then {r(f'avg({x})', n)} end"
    lag = lambda x, k: f"lag({x}, {k}) over ({w})"
    dv = lambda a, b: f"(({a}) / nullif({b}, 0))"
    s = lambda x, n: r(f"sum({x})", n)
    up, dn = "greatest(d, 0.0)", "greatest(-d, 0.0)"
    stoch = dv(f"close - {r('min(low)', 14)}", f"{r('max(high)', 14)} - {r('min(low)', 14)}")
    # greatest skips nulls in both engines: a first bar without a change counts as 0
    out = {
        "overlap_hl2": "hl2", "overlap_hlc3": "hlc3", "overlap_ohlc4": "(open + high + low + close) / 4", "overlap_wcp": "(high + low + 2 * close) / 4", "overlap_sma": sma("close", 10),
        "overlap_midpoint": full(2, f"({r('max(close)', 2)} + {r('min(close)', 2)}) / 2"), "overlap_midprice": full(2, f"({r('max(high)', 2)} + {r('min(low)', 2)}) / 2"), "overlap_vwma": full(10, dv(s("close * volume", 10), s("volume", 10))),
        "overlap_wma": full(10, f"({' + '.join(f'{10 - k} * {lag("close", k)}' for k in range(10))}) / 55"), "momentum_mom": f"close - {lag('close', 10)}", "momentum_roc": f"100 * {dv(f'close - {lag("close", 10)}', lag('close', 10))}",
        "momentum_willr": full(14, f"100 * ({stoch} - 1)"), "momentum_bias": f"{dv('close', sma('close', 26))} - 1", "momentum_bop": dv("close - open", "high - low"), "momentum_ao": f"{sma('hl2', 5)} - {sma('hl2', 34)}", "momentum_slope": "d",
        "momentum_psl": full(12, f"100 * {r('avg((d > 0)::int)', 12)}"), "momentum_er": dv(f"abs(close - {lag('close', 10)})", s("abs(d)", 10)), "momentum_cmo_sum": f"100 * {dv(f'{s(up, 14)} - {s(dn, 14)}', f'{s(up, 14)} + {s(dn, 14)}')}",
        "momentum_stoch_k": full(14, f"100 * {stoch}"), "momentum_brar_br": f"100 * {dv(s('greatest(high - pc, 0.0)', 26), s('greatest(pc - low, 0.0)', 26))}", "momentum_brar_ar": full(26, f"100 * {dv(s('high - open', 26), s('open - low', 26))}"),
        "trend_increasing": "(d > 0)::int", "trend_decreasing": "(d < 0)::int", "trend_qstick": sma("close - open", 10), "trend_vhf": full(28, dv(f"{r('max(close)', 28)} - {r('min(close)', 28)}", s("abs(d)", 28))),
        "trend_vortex_p": dv(s("vp", 14), s("tr", 14)), "trend_vortex_m": dv(s("vm", 14), s("tr", 14)),
        "trend_aroon_up": full(15, f"100 * (1 - (bar_idx - struct_extract({r("max({'x': high, 'i': bar_idx})", 15)}, 'i')) / 14.0)"), "trend_ttm": f"(close > {sma('hl2', 6)})::int",
        "statistics_zscore": dv(f"close - {sma('close', 30)}", full(30, r("stddev_samp(close)", 30))), "statistics_variance": full(30, r("var_samp(close)", 30)), "statistics_stdev": full(30, r("stddev_samp(close)", 30)),
        "statistics_median": full(30, r("quantile_cont(close, 0.5)", 30)), "statistics_quantile": full(30, r("quantile_cont(close, 0.25)", 30)), "volume_pvol": "close * volume", "volume_cmf": full(20, dv(s("clv * volume", 20), s("volume", 20))),
        "volume_ad": s("clv * volume", 0), "volume_obv": s("sign(d) * volume", 0), "volume_pvt": s("100 * (d / nullif(pc, 0)) * volume", 0),
        "volume_mfi": f"100 * {dv(s('case when dtp > 0 then hlc3 * volume else 0.0 end', 14), s('case when dtp <> 0 then hlc3 * volume else 0.0 end', 14))}",
        "candles_cdl_doji": f"(abs(close - open) < 0.1 * {full(10, r('avg(high - low)', 10))})::int", "candles_cdl_inside": "(high < ph and low > pl)::int",
    }
    return {f"ta_{k}": f"coalesce({x}, 0.0)" for k, x in out.items()}


def _known(*arrays: np.ndarray) -> np.ndarray:
    return ~np.isnan(np.sum(arrays, axis=0))


def _filled(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(len(known), np.nan)
    out[known] = values
    return out


# ---- recurrences that forget: a block's halo is enough -----------------------------------------------------------------


def _super_smoother(x: np.ndarray, n: int = 10) -> np.ndarray:
    """A two-pole filter; its first two values are x."""
    known = _known(x)
    c, q = x[known], np.exp(-np.sqrt(2) * np.pi / n)
    c2, c3 = 2 * q * np.cos(np.sqrt(2) * np.pi / n), -q * q
    out = c.copy()
    for i in range(2, len(c)):
        out[i] = (1 - c2 - c3) * c[i] + c2 * out[i - 1] + c3 * out[i - 2]
    return _filled(known, out)


def _holt_winters(x: np.ndarray, level: float = 0.2, speed: float = 0.1, force: float = 0.1) -> np.ndarray:
    known = _known(x)
    c = x[known]
    f, v, a, out = c[0] if len(c) else 0.0, 0.0, 0.0, np.zeros(len(c))
    for i in range(len(c)):
        new_f = (1 - level) * (f + v + a / 2) + level * c[i]
        new_v = (1 - speed) * (v + a) + speed * (new_f - f)
        a = (1 - force) * a + force * (new_v - v)
        f, v = new_f, new_v
        out[i] = f + v + a / 2
    return _filled(known, out)


def _fisher(place: np.ndarray) -> np.ndarray:
    out, value, before = np.zeros(len(place)), 0.0, 0.0
    for i, p in enumerate(place.tolist()):
        value = min(0.999, max(-0.999, 0.66 * p + 0.67 * value))
        before = out[i] = 0.5 * np.log((1 + value) / (1 - value)) + 0.5 * before
    return out


def _heikin_open(o: np.ndarray, c: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Halfway between its own last value and the last bar's mean price."""
    known = _known(o, c, mean)
    first, m = ((o + c) / 2)[known], mean[known]
    out = first.copy()
    for i in range(1, len(m)):
        out[i] = (out[i - 1] + m[i - 1]) / 2
    return _filled(known, out)


# ---- recurrences that may not: their state is handed on from block to block --------------------------------------------


def _since_known(x: np.ndarray, n: int) -> np.ndarray:
    """Whether a bar and all n bars before it are known."""
    return (pd.Series(~np.isnan(x)).astype(float).rolling(n + 1).sum() == n + 1).to_numpy()


def _kama_inputs(d: pd.DataFrame, n: int = 10, fast: int = 2, slow: int = 30):
    """x itself for n bars, then towards x by the share that the efficiency of the last n bars gives."""
    s = d["close"].astype(float)
    x, er = s.to_numpy(), (s - s.shift(n)).abs() / s.diff().abs().rolling(n).sum().replace(0, np.nan)
    share = ((er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2).fillna(0.0).to_numpy()
    share, known = np.where(_since_known(x, n), share, 1.0), ~np.isnan(x)
    return np.where(known, 1 - share, 1.0), np.where(known, share * np.nan_to_num(x), 0.0), known


def _vidya_inputs(d: pd.DataFrame, n: int = 14):
    s = d["close"].astype(float)
    x, step = s.to_numpy(), s.diff()
    up, down = step.clip(lower=0).rolling(n).sum(), (-step).clip(lower=0).rolling(n).sum()
    share = ((up - down) / (up + down).replace(0, np.nan)).abs().fillna(0.0).to_numpy() * 2 / (n + 1)
    share, known = np.where(_since_known(x, n), share, 1.0), ~np.isnan(x)
    return np.where(known, 1 - share, 1.0), np.where(known, share * np.nan_to_num(x), 0.0), known


def _supertrend(arrays, state):
    """The side that close is on, and bands that only close in on it. State: upper band, lower band, side."""
    hi, lo, c = arrays
    out = np.full(len(c), np.nan)
    top, bottom, side = state or (None, None, 1)
    for i in range(len(c)):
        if top is None:
            top, bottom = hi[i], lo[i]
            continue
        side = 1 if c[i] > top else -1 if c[i] < bottom else side
        top, bottom = (hi[i], max(lo[i], bottom)) if side > 0 else (min(hi[i], top), lo[i])
        out[i] = bottom if side > 0 else top
    return [out], [top, bottom, side]


def _parabola(arrays, state, step: float = 0.02, top: float = 0.2):
    """Moved towards the extreme, and started anew there when it is crossed. State: whether it runs, upwards, acceleration, extreme, place; before it runs the first bar's high and low."""
    h, l = arrays  # noqa: E741
    out = np.full(len(h), np.nan)
    runs, up, af, ext, sar = state or (0.0, 0.0, step, np.nan, np.nan)
    for i in range(len(h)):
        if not runs:
            if np.isnan(ext):
                ext, sar = h[i], l[i]
                continue
            runs, up = 1.0, float(h[i] >= ext)
            ext, sar = (ext, sar) if up else (sar, ext)
        sar += af * (ext - sar)
        if (l[i] < sar) if up else (h[i] > sar):
            up, sar, ext, af = 1.0 - up, ext, (l[i] if up else h[i]), step
        elif (h[i] > ext) if up else (l[i] < ext):
            ext, af = (h[i] if up else l[i]), min(top, af + step)
        out[i] = sar
    return [out], [runs, up, af, ext, sar]


def _mcginley(arrays, state, n: int = 10):
    (x,) = arrays
    out, md = np.empty(len(x)), state[0] if state else None
    for i, c in enumerate(x.tolist()):
        if md is None:
            md = c
        else:
            md = md + (c - md) / (n * max(c / md if md else 1.0, 1e-3) ** 4)
        out[i] = md
    return [out], [md]


def _decay(arrays, state, step: float = 0.2):
    (x,) = arrays
    out, value = np.empty(len(x)), state[0] if state else None
    for i, c in enumerate(x.tolist()):
        value = c if value is None else max(c, value - step, 0.0)
        out[i] = value
    return [out], [value]


def _places(x: np.ndarray, hi: np.ndarray, lo: np.ndarray, place: float, value: float | None, share: float = 0.5):
    """Where x stands between two extremes, in percent, each value halfway from the one before; the last place where they meet."""
    out = np.zeros(len(x))
    for i in range(len(x)):
        if hi[i] > lo[i]:
            place = 100 * (x[i] - lo[i]) / (hi[i] - lo[i])
        value = place if value is None else value + share * (place - value)
        out[i] = value
    return out, place, value


def _schaff(arrays, state, n: int = 10):
    """The place of x in its range, and that place's own in its range of n bars. State: place and value of both, the first's last n - 1 values."""
    x, hi, lo = arrays
    p1, v1, p2, v2, *last = state or (0.0, None, 0.0, None, *[np.nan] * (n - 1))
    inner, p1, v1 = _places(x, hi, lo, p1, v1)
    whole = np.r_[last, inner]
    hi2, lo2 = (ewm.rolling_extreme(whole, n, k)[0][n - 1 :] for k in (True, False))
    outer, p2, v2 = _places(inner, hi2, lo2, p2, v2)
    return [outer], [p1, v1, p2, v2, *whole[-(n - 1) :]]


def _trailing(arrays, state):
    """A band that follows x at a distance, rises only below it and falls only above it, and changes side when x crosses it. State: both bands, side, x."""
    x, width = arrays
    out = np.full(len(x), np.nan)
    low, high, side, before = state or (np.nan, np.nan, 1, np.nan)
    for i in range(len(x)):
        new_low, new_high = x[i] - width[i], x[i] + width[i]
        if not np.isnan(low):
            side = 1 if x[i] > high else -1 if x[i] < low else side
            new_low = max(low, new_low) if before > low and x[i] > low else new_low
            new_high = min(high, new_high) if before < high and x[i] < high else new_high
        low, high, before = new_low, new_high, x[i]
        out[i] = low if side > 0 else high
    return [out], [low, high, side, before]


def _smoothed(x: pd.Series, n: int) -> pd.Series:
    return ewm.ewm_mean(x, 2 / (n + 1))


def _macd(d: pd.DataFrame) -> pd.Series:
    c = d["close"].astype(float)
    return _smoothed(c, 12) - _smoothed(c, 26)


def _bands(d: pd.DataFrame, n: int = 7, k: float = 3.0):
    mid, atr = (d["high"] + d["low"]) / 2, ewm.wilder(ewm.true_range(d), n)
    return tuple(np.asarray(x, float) for x in (mid + k * atr, mid - k * atr, d["close"]))


def _schaff_inputs(d: pd.DataFrame, n: int = 10):
    x = _macd(d).to_numpy(float)
    return x, ewm.rolling_extreme(x, n)[0], ewm.rolling_extreme(x, n, False)[0]


def _trailing_inputs(d: pd.DataFrame):
    x = _smoothed(ewm.rsi(d["close"].astype(float)), 5)
    return x.to_numpy(float), (4.236 * _smoothed(_smoothed(x.diff().abs(), 27), 27)).to_numpy(float)


#: Column, its inputs from a block and its halo, how it goes on, and the numbers in its state.
PATHS = (
    Recurrence(("ta_overlap_kama",), _kama_inputs), Recurrence(("ta_overlap_vidya",), _vidya_inputs),
    Recurrence(("ta_overlap_supertrend",), _bands, _supertrend, 3),
    Recurrence(("ta_trend_psar",), lambda d: (d["high"].to_numpy(float), d["low"].to_numpy(float)), _parabola, 5),
    Recurrence(("ta_overlap_mcgd",), lambda d: (d["close"].to_numpy(float),), _mcginley, 1),
    Recurrence(("ta_trend_decay",), lambda d: (d["close"].to_numpy(float),), _decay, 1),
    Recurrence(("ta_momentum_stc",), _schaff_inputs, _schaff, 13), Recurrence(("ta_momentum_qqe",), _trailing_inputs, _trailing, 4),
)
#: What the longest chain of smoothings remembers: Wilder's of 14 bars and two of 27, or three of 30.
HALO = max(ewm.memory(1 / 14) + ewm.memory(1 / 3) + 2 * ewm.memory(1 / 14), 3 * ewm.memory(2 / 31)) + 60


def recursive_indicators(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Indicators built on exponential smoothing or a recurrence, in blocks of a series (rows: their least size). Each begins with the first bar that is known."""
    names = [f"ta_{k}" for k in (
        "overlap_ema", "overlap_rma", "overlap_dema", "overlap_tema", "overlap_t3", "overlap_zlma", "overlap_kama", "overlap_supertrend", "overlap_mcgd", "overlap_ssf", "momentum_rsi", "momentum_macd", "momentum_macd_signal", "momentum_macd_hist",
        "momentum_ppo", "momentum_apo", "momentum_trix", "momentum_tsi", "momentum_pvo", "momentum_stochrsi", "momentum_cmo", "momentum_kdj_k", "momentum_kdj_d", "momentum_kdj_j", "momentum_fisher", "momentum_eri_bull", "momentum_eri_bear", "momentum_pgo",
        "trend_adx", "trend_dmp", "trend_dmn", "trend_psar", "trend_decay", "volume_efi", "volume_adosc", "volume_kvo", "volume_aobv",
        "candles_ha_open", "candles_ha_close",
        "momentum_smi", "momentum_smi_signal", "momentum_smi_osc", "momentum_inertia", "momentum_squeeze", "momentum_squeeze_on", "momentum_squeeze_off", "momentum_squeeze_pro_wide", "momentum_squeeze_pro_normal", "momentum_squeeze_pro_narrow",
        "momentum_stc", "momentum_stc_macd", "momentum_qqe", "momentum_qqe_rsi_ma", "overlap_hwma", "overlap_vidya", "trend_cksp_long", "trend_cksp_short", "trend_amat_long", "trend_amat_short",
    )]

    def fn(d: pd.DataFrame) -> dict:
        o, h, l, c, v = (d[k].astype(float) for k in ("open", "high", "low", "close", "volume"))  # noqa: E741
        e = lambda x, n: ewm.ewm_mean(x, 2 / (n + 1))
        nz = lambda x: x.replace(0, np.nan)
        tr, change, tp = ewm.true_range(d), c.diff(), (h + l + c) / 3
        out: dict = {}
        e1, e2 = e(c, 10), e(e(c, 10), 10)
        e3 = e(e2, 10)
        out["overlap_ema"], out["overlap_rma"], out["overlap_dema"], out["overlap_tema"] = e1, ewm.wilder(c, 10), 2 * e1 - e2, 3 * e1 - 3 * e2 + e3
        x = [c]
        for _ in range(6):
            x.append(e(x[-1], 10))
        a = 0.7
        out["overlap_t3"] = -(a**3) * x[6] + 3 * (a**2 + a**3) * x[5] - 3 * (2 * a**2 + a + a**3) * x[4] + (1 + 3 * a + a**3 + 3 * a**2) * x[3]
        out["overlap_zlma"] = e(2 * c - c.shift(4), 10)
        arr = c.to_numpy()
        out["overlap_ssf"], out["overlap_hwma"] = _super_smoother(arr), _holt_winters(arr)
        r = ewm.rsi(c)
        out["momentum_rsi"] = r
        macd = e(c, 12) - e(c, 26)
        out["momentum_macd"], out["momentum_macd_signal"] = macd, e(macd, 9)
        out["momentum_macd_hist"] = macd - e(macd, 9)
        out["momentum_apo"], out["momentum_ppo"], out["momentum_pvo"] = e(c, 12) - e(c, 26), 100 * macd / nz(e(c, 26)), 100 * (e(v, 12) - e(v, 26)) / nz(e(v, 26))
        t = e(e(e(c, 30), 30), 30)
        out["momentum_trix"] = 100 * (t / nz(t.shift()) - 1)
        out["momentum_tsi"] = 100 * e(e(change, 25), 13) / nz(e(e(change.abs(), 25), 13))
        lo, hi = r.rolling(14).min(), r.rolling(14).max()
        out["momentum_stochrsi"] = (100 * (r - lo) / nz(hi - lo)).rolling(3).mean()
        up, dn = ewm.wilder(change.clip(lower=0), 14), ewm.wilder((-change).clip(lower=0), 14)
        out["momentum_cmo"] = 100 * (up - dn) / nz(up + dn)
        k = ewm.wilder((100 * (c - l.rolling(9).min()) / nz(h.rolling(9).max() - l.rolling(9).min())), 3)
        dd = ewm.wilder(k, 3)
        out["momentum_kdj_k"], out["momentum_kdj_d"], out["momentum_kdj_j"] = k, dd, 3 * k - 2 * dd
        mid = (h + l) / 2
        pos = (mid - mid.rolling(9).min()) / nz(mid.rolling(9).max() - mid.rolling(9).min()) - 0.5
        out["momentum_fisher"] = _fisher(pos.fillna(0.0).to_numpy())
        out["momentum_eri_bull"], out["momentum_eri_bear"] = h - e(c, 13), l - e(c, 13)
        # without a move the distance is 0, whatever the last places of the mean say
        out["momentum_pgo"] = (c - c.rolling(14).mean()).where(c.rolling(14).max() > c.rolling(14).min(), 0.0) / nz(e(tr, 14))
        out["trend_adx"] = ewm.adx(d)
        pu, pd_ = h.diff(), -l.diff()
        atr = nz(ewm.wilder(tr, 14))
        out["trend_dmp"] = 100 * ewm.wilder(pu.where((pu > pd_) & (pu > 0), 0.0), 14) / atr
        out["trend_dmn"] = 100 * ewm.wilder(pd_.where((pd_ > pu) & (pd_ > 0), 0.0), 14) / atr
        out["volume_efi"] = e(change * v, 13)
        ad = (((2 * c - h - l) / nz(h - l)).fillna(0.0) * v).cumsum()
        out["volume_adosc"] = e(ad, 3) - e(ad, 10)
        sv = v * np.sign(tp.diff().fillna(0.0))
        out["volume_kvo"] = e(sv, 34) - e(sv, 55)
        obv = (np.sign(change.fillna(0.0)) * v).cumsum()
        out["volume_aobv"] = e(obv, 4) - e(obv, 12)
        hac = ((o + h + l + c) / 4).to_numpy()
        out["candles_ha_open"], out["candles_ha_close"] = _heikin_open(o.to_numpy(), c.to_numpy(), hac), hac
        smi = e(e(change, 20), 5) / nz(e(e(change.abs(), 20), 5))
        out["momentum_smi"], out["momentum_smi_signal"], out["momentum_smi_osc"] = smi, e(smi, 5), smi - e(smi, 5)
        sd14 = c.rolling(14).std(ddof=0)
        rvi_up, rvi_dn = e(sd14.where(change > 0, 0.0), 14), e(sd14.where(change <= 0, 0.0), 14)
        rvi, line = 100 * rvi_up / nz(rvi_up + rvi_dn), np.array(fitted(20))
        out["momentum_inertia"] = sum(w * rvi.shift(k) for k, w in enumerate(line))
        sd20, mean20, mid20, range20 = c.rolling(20).std(ddof=0), c.rolling(20).mean(), e(c, 20), e(tr, 20)
        inside = lambda k: ((mean20 - 2 * sd20 > mid20 - k * range20) & (mean20 + 2 * sd20 < mid20 + k * range20)).astype(float)
        out["momentum_squeeze"], out["momentum_squeeze_on"] = (c - c.shift(12)).rolling(6).mean(), inside(1.5)
        out["momentum_squeeze_off"] = ((mean20 - 2 * sd20 < mid20 - 1.5 * range20) & (mean20 + 2 * sd20 > mid20 + 1.5 * range20)).astype(float)
        for name, k in (("wide", 2.0), ("normal", 1.5), ("narrow", 1.0)):
            out[f"momentum_squeeze_pro_{name}"] = inside(k)
        out["momentum_stc_macd"] = macd
        smooth = e(r, 5)
        out["momentum_qqe_rsi_ma"] = smooth
        rma10 = ewm.wilder(tr, 10)
        out["trend_cksp_long"], out["trend_cksp_short"] = (h.rolling(10).max() - rma10).rolling(9).max(), (l.rolling(10).min() + rma10).rolling(9).min()
        rising = lambda x: x > x.shift(2)
        falling = lambda x: x < x.shift(2)
        near, far = e(c, 8), e(c, 21)
        out["trend_amat_long"], out["trend_amat_short"] = (rising(near) & (rising(far) | falling(far))).astype(float), (falling(near) & (falling(far) | rising(far))).astype(float)
        return {f"ta_{n}": x for n, x in out.items()}

    found = scanned(bars, names, list(PATHS), HALO, fn, rows=rows)
    return found.select(*KEYS, *[zero(n).alias(n) for n in names])
