"""Indicators that windows and lags can say, as SQL expressions in stages: each stage is a projection that names columns of those before.

All share one partitioning and order, so a plan has one exchange and one sort for them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.exprs import KEYS

W = "partition by series_id order by bar_idx"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({W})" if k else f"({x})"


def roll(f: str, n: int) -> str:
    return f"{f} over ({W} rows between {n - 1} preceding and current row)"


def so_far(f: str) -> str:
    return f"{f} over ({W} rows between unbounded preceding and current row)"


def over(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def full(n: int, x: str, of: str = "close") -> str:
    """x where a whole window of n is known."""
    return f"case when {roll(f'count({of})', n)} >= {n} then {x} end"


def mean(x: str, n: int) -> str:
    return full(n, roll(f"avg({x})", n), x)


def weighted(x: str, weights: list[float]) -> str:
    """The weighted mean of the last values, the newest weighted first."""
    total = math.fsum(weights)
    return "(" + " + ".join(f"({w / total!r}D) * {lag(x, k)}" for k, w in enumerate(weights)) + ")"


def fitted(n: int, ahead: int = 0) -> list[float]:
    """Weights, the newest first, that give the value at the end (or `ahead` bars on) of the line through n values."""
    mid, spread = (n - 1) / 2, n * (n * n - 1) / 12
    return [1 / n + (n - 1 + ahead - mid) * (n - 1 - k - mid) / spread for k in range(n)]


def _alma(n: int, sigma: float = 6.0, offset: float = 0.85) -> list[float]:
    at, width = math.floor(offset * (n - 1)), n / sigma
    return [math.exp(-((n - 1 - k - at) ** 2) / (2 * width * width)) for k in range(n)]


def _fibonacci(n: int) -> list[float]:
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return [float(x) for x in reversed(out[:n])]


def linear(n: int) -> list[float]:
    return [float(n - k) for k in range(n)]


def change(n: int) -> str:
    return f"100 * ({over('close', lag('close', n))} - 1)"


def moments(n: int, power: int) -> str:
    return "(" + " + ".join(f"power(({lag('close', k)} - m30) / nullif(s30, 0), {power})" for k in range(n)) + ")"


STAGES: list[dict[str, str]] = [
    {
        "pc": lag("close"), "hl2": "(high + low) / 2", "tp": "(high + low + close) / 3", "day": "date_trunc('day', ts)",
        "tr": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))", "bp": f"close - least(low, coalesce({lag('close')}, low))",
        "ret": f"coalesce({over('close', lag('close'))} - 1, 0)", "dv": f"coalesce(volume - {lag('volume')}, 0)",
    },
    {
        "m14": mean("tp", 14), "m30": mean("close", 30), "s30": full(30, roll("stddev_samp(close)", 30)), "hull": f"2 * {weighted('close', linear(5))} - {weighted('close', linear(10))}", "tri": mean("close", 6),
        "share": over("close", full(10, roll("sum(close)", 10))), "steps": f"{change(14)} + {change(11)}", "hi13": f"round({mean("high", 13)}, 8)", "lo21": f"round({mean("low", 21)}, 8)",
        **{f"roc{n}": change(n) for n in (10, 15, 20, 30)}, "rise": f"case when close > {lag('close', 4)} then 1 else 0 end", "fall": f"case when close < {lag('close', 4)} then 1 else 0 end",
        "body": weighted("close - open", [1.0, 2.0, 2.0, 1.0]), "reach": weighted("high - low", [1.0, 2.0, 2.0, 1.0]), "slope_all": "regr_slope(close, bar_idx) over (partition by series_id)", "base_all": "regr_intercept(close, bar_idx) over (partition by series_id)",
        "sd_all": "stddev_samp(close) over (partition by series_id)", "ease": over(f"(hl2 - {lag('hl2')}) * (high - low)", "volume / 1000000"),
    },
    {
        "bits": "case when share > 0 then -share * log2(share) end", "rvgi": over(full(14, roll("sum(body)", 14), "body"), full(14, roll("sum(reach)", 14), "reach")),
        "held": f"case when close > {lag('hi13')} then lo21 when close < {lag('lo21')} then hi13 end", "line_all": "base_all + slope_all * bar_idx",
    },
]
STAGES[1] |= {f"z_{k}": f"({k} - {mean(k, 30)}) / nullif({full(30, roll(f'stddev_samp({k})', 30), k)}, 0)" for k in ("open", "high", "low", "close")}

INDICATORS: dict[str, str] = {
    "overlap_hma": weighted("hull", linear(3)), "overlap_ma": mean("close", 10), "overlap_swma": weighted("close", [float(min(k + 1, 10 - k)) for k in range(10)]), "overlap_pwma": weighted("close", [float(math.comb(9, k)) for k in range(10)]),
    "overlap_trima": mean("tri", 6), "overlap_linreg": weighted("close", fitted(14)), "overlap_fwma": weighted("close", _fibonacci(10)), "overlap_sinwma": weighted("close", [math.sin((k + 1) * math.pi / 15) for k in range(14)]), "overlap_alma": weighted("close", _alma(10)),
    "overlap_hilo": f"last_value(held) ignore nulls over ({W} rows between unbounded preceding and current row)",
    "overlap_vwap": "sum(tp * volume) over (partition by series_id, day order by bar_idx rows between unbounded preceding and current row) / nullif(sum(volume) over (partition by series_id, day order by bar_idx rows between unbounded preceding and current row), 0)",
    "momentum_cci": over("tp - m14", "0.015 * (" + " + ".join(f"abs({lag('tp', k)} - m14)" for k in range(14)) + ") / 14"), "momentum_cg": over("-(" + " + ".join(f"{k + 1} * {lag('close', k)}" for k in range(10)) + ")", full(10, roll("sum(close)", 10))),
    "momentum_coppock": weighted("steps", linear(10)), "momentum_kst": " + ".join(f"{w} * {mean(f'roc{n}', m)}" for w, n, m in ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15))),
    "momentum_uo": "100 * (" + " + ".join(f"{w} * {over(full(n, roll('sum(bp)', n)), full(n, roll('sum(tr)', n)))}" for w, n in ((4, 7), (2, 14), (1, 28))) + ") / 7",
    "momentum_cti": f"case when {roll('max(close)', 12)} > {roll('min(close)', 12)} then (" + " + ".join(f"{5.5 - k} * {lag('close', k)}" for k in range(12)) + f") / sqrt(12 * 143 * {roll('var_pop(close)', 12)}) end", "momentum_cfo": f"100 * {over(f'close - {weighted("close", fitted(9, 1))}', 'close')}", "momentum_rvgi": "rvgi", "momentum_rvgi_signal": weighted("rvgi", [1.0, 2.0, 2.0, 1.0]),
    "momentum_td_seq_up": f"bar_idx - {so_far('max(case when rise = 0 then bar_idx end)')}", "momentum_td_seq_down": f"bar_idx - {so_far('max(case when fall = 0 then bar_idx end)')}",
    "trend_chop": f"100 * log10({over(full(14, roll('sum(tr)', 14)), full(14, f'{roll("max(high)", 14)} - {roll("min(low)", 14)}'))}) / {math.log10(14)!r}D",
    "statistics_skew": f"{30 / (29 * 28)!r}D * {moments(30, 3)}", "statistics_kurtosis": f"{30 * 31 / (29 * 28 * 27)!r}D * {moments(30, 4)} - {3 * 29 * 29 / (28 * 27)!r}D", "statistics_mad": "(" + " + ".join(f"abs({lag('close', k)} - m30)" for k in range(30)) + ") / 30",
    "statistics_entropy": full(10, roll("sum(bits)", 10), "bits"), "statistics_tos_stdevall": "line_all", **{f"statistics_tos_stdevall_{s}{k}": f"line_all {'+' if s == 'u' else '-'} {k} * sd_all" for s in "lu" for k in (1, 2, 3)},
    "volume_nvi": f"1000 + {so_far('sum(case when dv < 0 then 100 * ret else 0 end)')}", "volume_pvi": f"1000 + {so_far('sum(case when dv > 0 then 100 * ret else 0 end)')}", "volume_eom": mean("ease", 14),
    "volume_pvr": "case when close is null or pc is null then null when close >= pc then case when dv >= 0 then 1 else 2 end when dv >= 0 then 3 else 4 end",
    **{f"candles_cdl_z_{k}": f"z_{k}" for k in ("open", "high", "low", "close")},
}


def indicators(bars: DataFrame) -> DataFrame:
    """series_id, bar_idx and ta_<name> of INDICATORS; 0 where a window isn't full yet or a divisor is 0."""
    df = bars
    for stage in STAGES:
        df = df.select("*", *[F.expr(x).alias(k) for k, x in stage.items()])
    return df.select(*KEYS, *[F.expr(f"cast(coalesce({x}, 0) as double)").alias(f"ta_{k}") for k, x in INDICATORS.items()])


def stages_sql(source: str = "bars") -> str:
    """The stages as CTEs stage0, stage1, ... for DuckDB; the last is what INDICATORS name columns of."""
    out = ""
    for k, stage in enumerate(STAGES):
        out += f",\nstage{k} as (select *, {', '.join(f'{plain(x)} as {c}' for c, x in stage.items())} from {source})"
        source = f"stage{k}"
    return out


def plain(x: str) -> str:
    """An expression without what only Spark's SQL has: suffixes of doubles, nulls ignored outside the call."""
    import re

    x = re.sub(r"(?<=[0-9])D\b", "::double", x)
    return re.sub(r"last_value\((\w+)\) ignore nulls", r"last_value(\1 ignore nulls)", x)
