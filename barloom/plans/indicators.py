"""SQL for the indicators that follow a recurrence: a recursive walk over each series, then windows over what it leaves."""

from __future__ import annotations

import math

from barloom.operators import technical as TA
from barloom.operators.exprs import KEYS
from barloom.operators.staged import fitted
from barloom.plans.base import GAPPED, WHOLE_GAPPED, W, gapped_bars_of, lag, over_bars, query, roll, rounded
from barloom.plans.recurrences import ADX, TRUE_RANGE, _rsi, ema, span, walk


def gapped(y: str, x: str, alpha: float) -> dict[str, tuple[str, str]]:
    """Two states: a smoothed value whose own weight fades while x is missing, and that weight."""
    f = 1 - alpha
    return {
        y: (f"({x})::double", f"case when {y} is null or ({x}) is null then coalesce({y}, {x}) else ({y}_w * {f!r} * {y} + {alpha!r} * ({x})) / ({y}_w * {f!r} + {alpha!r}) end"),
        f"{y}_w": ("1.0::double", f"case when ({x}) is not null or {y} is null then 1.0 else {y}_w * {f!r} end"),
    }


_full = lambda n, f, x: f"case when {roll(f'count({x})', n)} >= {n} then {roll(f'{f}({x})', n)} end"
_sd = lambda n, x: f"case when {roll(f'count({x})', n)} >= {n} then case when {roll(f'max({x})', n)} > {roll(f'min({x})', n)} then {roll(f'stddev_pop({x})', n)} else 0.0 end end"
_over = lambda a, b: f"(({a}) / nullif({b}, 0))"

_BEFORE = f""",
m0 as (select *, {TRUE_RANGE} as tr, close - {lag('close')} as change, (high + low) / 2 as hl2, (high + low + close) / 3 as tp, coalesce((2 * close - high - low) / nullif(high - low, 0), 0.0) as clv,
  case when high - {lag('high')} > {lag('low')} - low and high > {lag('high')} then high - {lag('high')} else 0.0 end as up, case when {lag('low')} - low > high - {lag('high')} and low < {lag('low')} then {lag('low')} - low else 0.0 end as down from bars),
m1 as (select *, 2 * close - {lag('close', 4)} as zl, 100 * {_over(f"close - {_full(9, 'min', 'low')}", f"{_full(9, 'max', 'high')} - {_full(9, 'min', 'low')}")} as rsv, change * volume as force, sum(clv * volume) over ({W} rows unbounded preceding) as ad,
  sum(coalesce(sign(change), 0) * volume) over ({W} rows unbounded preceding) as obv, volume * coalesce(sign(tp - {lag('tp')}), 0) as sv, coalesce({_over(f"hl2 - {_full(9, 'min', 'hl2')}", f"{_full(9, 'max', 'hl2')} - {_full(9, 'min', 'hl2')}")} - 0.5, 0.0) as pos,
  coalesce(({_over(f"abs(close - {lag('close', 10)})", _full(10, 'sum', 'abs(change)'))} * {2 / 3 - 2 / 31!r} + {2 / 31!r}) ** 2, 0.0) as sc,
  coalesce(abs({_over(f"{_full(14, 'sum', 'greatest(change, 0.0) + 0 * change')} - {_full(14, 'sum', 'greatest(-change, 0.0) + 0 * change')}", f"{_full(14, 'sum', 'abs(change)')}")}), 0.0) * {2 / 15!r} as vk,
  {_sd(14, 'close')} as sd14, (open + high + low + close) / 4 as hac, lead(high) over ({W}) as nh from m0),
m2 as (select *, case when change > 0 then sd14 else 0.0 end as rv_up, case when change <= 0 then sd14 else 0.0 end as rv_down from m1)"""

_q = math.exp(-math.sqrt(2) * math.pi / 10)
_c2, _c3 = 2 * _q * math.cos(math.sqrt(2) * math.pi / 10), -_q * _q
_S: dict[str, tuple[str, str]] = {"a1": ema("a1", "$close", span(10))}
for _k in range(2, 7):
    _S[f"a{_k}"] = ema(f"a{_k}", f"@a{_k - 1}", span(10))
_S |= {"rma": ema("rma", "$close", 0.1), "zlma": ema("zlma", "$zl", span(10)), "rma_tr10": ema("rma_tr10", "$tr", 0.1), "st_atr": ema("st_atr", "$tr", 1 / 7)}
_S |= {f"c{n}": ema(f"c{n}", "$close", span(n)) for n in (12, 13, 20, 26)} | {f"v{n}": ema(f"v{n}", "$volume", span(n)) for n in (12, 26)} | {f"tr{n}": ema(f"tr{n}", "$tr", span(n)) for n in (14, 20)}
_S |= {"signal": ema("signal", "@c12 - @c26", span(9)), "x1": ema("x1", "$close", span(30)), "x2": ema("x2", "@x1", span(30)), "x3": ema("x3", "@x2", span(30))}
_S |= {"p1": ema("p1", "$change", span(25)), "p2": ema("p2", "@p1", span(13)), "q1": ema("q1", "abs($change)", span(25)), "q2": ema("q2", "@q1", span(13)), **_rsi, **ADX}
_S |= {"s1": ema("s1", "$change", span(20)), "s2": ema("s2", "@s1", span(5)), "u1": ema("u1", "abs($change)", span(20)), "u2": ema("u2", "@u1", span(5)), "smi_signal": ema("smi_signal", "@s2 / nullif(@u2, 0)", span(5))}
_S |= gapped("kk", "$rsv", 1 / 3) | gapped("kd", "@kk", 1 / 3) | gapped("rvu", "$rv_up", span(14)) | gapped("rvd", "$rv_down", span(14))
_S |= {"efi": ema("efi", "$force", span(13)), **{f"ad{n}": ema(f"ad{n}", "$ad", span(n)) for n in (3, 10)}, **{f"sv{n}": ema(f"sv{n}", "$sv", span(n)) for n in (34, 55)}, **{f"ob{n}": ema(f"ob{n}", "$obv", span(n)) for n in (4, 12)}}
_S |= {
    "kama": ("$close", "case when bar_idx + 1 < 10 then $close else kama + $sc * ($close - kama) end"), "vidya": ("$close", "case when bar_idx + 1 < 14 then $close else $vk * $close + (1 - $vk) * vidya end"),
    "decay": ("$close", "greatest($close, decay - 0.2, 0.0)"), "ss_b": ("$close", "ss"), "ss": ("$close", f"case when bar_idx + 1 < 2 then $close else {1 - _c2 - _c3!r} * $close + {_c2!r} * ss + {_c3!r} * ss_b end"),
    "hw_f": ("0.8 * $close + 0.2 * $close", "0.8 * (hw_f + hw_v + hw_a / 2) + 0.2 * $close"), "hw_v": ("0.1 * (@hw_f - $close)", "0.9 * (hw_v + hw_a) + 0.1 * (@hw_f - hw_f)"), "hw_a": ("0.1 * @hw_v", "0.9 * hw_a + 0.1 * (@hw_v - hw_v)"),
    "ha_c": ("$hac", "$hac"), "ha_o": ("($open + $close) / 2", "(ha_o + ha_c) / 2"),
    "fv": ("least(0.999, greatest(-0.999, 0.66 * $pos))", "least(0.999, greatest(-0.999, 0.66 * $pos + 0.67 * fv))"), "fish": ("0.5 * ln((1 + @fv) / (1 - @fv))", "0.5 * ln((1 + @fv) / (1 - @fv)) + 0.5 * fish"),
    # supertrend: the side that close is on, and bands that only close in on it
    "st_side": ("1", "case when $close > st_hi then 1 when $close < st_lo then -1 else st_side end"),
    "st_lo": ("$hl2 - 3 * @st_atr", "case when @st_side > 0 then greatest($hl2 - 3 * @st_atr, st_lo) else $hl2 - 3 * @st_atr end"), "st_hi": ("$hl2 + 3 * @st_atr", "case when @st_side > 0 then $hl2 + 3 * @st_atr else least($hl2 + 3 * @st_atr, st_hi) end"),
    # the parabola: moved towards the extreme, and started anew there when it is crossed
    "ps_t": ("0.0::double", "sar + af * (ext - sar)"), "ps_flip": ("false", "case when ps_up then $low < @ps_t else $high > @ps_t end"),
    "sar": ("case when $nh >= $high then $low else $high end", "case when @ps_flip then ext else @ps_t end"),
    "af": ("0.02::double", "case when @ps_flip then 0.02 when ps_up and $high > ext or not ps_up and $low < ext then least(0.2, af + 0.02) else af end"),
    "ext": ("case when $nh >= $high then $high else $low end", "case when @ps_flip then case when ps_up then $low else $high end when ps_up and $high > ext then $high when not ps_up and $low < ext then $low else ext end"),
    "ps_up": ("$nh >= $high", "case when @ps_flip then not ps_up else ps_up end"),
}
for _k, (_a, _b) in list(_S.items()):  # numbers of the first bar decide a column's type: doubles, but for flags
    if _k not in ("ps_flip", "ps_up", "st_side"):
        _S[_k] = (f"({_a})::double", _b)

_inputs = {x: x for x in ("close", "open", "high", "low", "volume", "tr", "change", "hl2", "up", "down", "zl", "rsv", "force", "ad", "obv", "sv", "pos", "sc", "vk", "rv_up", "rv_down", "hac", "nh")}
_AFTER = f""",
w0 as (select * exclude (up, down), 100 * gain / nullif(gain + loss, 0) as rsi, 100 * rvu / nullif(rvu + rvd, 0) as rvi, c12 - c26 as macd from m2 join walked using (series_id, bar_idx)),
w1 as (select *, 100 * {_over(f"rsi - {_full(14, 'min', 'rsi')}", f"{_full(14, 'max', 'rsi')} - {_full(14, 'min', 'rsi')}")} as stoch, close - {lag('close', 12)} as mom12, {_full(10, 'max', 'high')} - rma_tr10 as ck_long, {_full(10, 'min', 'low')} + rma_tr10 as ck_short from w0)"""
_t3 = 0.7
_CELLS = {
    "overlap_ema": "a1", "overlap_rma": "rma", "overlap_dema": "2 * a1 - a2", "overlap_tema": "3 * a1 - 3 * a2 + a3", "overlap_zlma": "zlma", "overlap_kama": "kama", "overlap_ssf": "ss", "overlap_hwma": "hw_f + hw_v + hw_a / 2", "overlap_vidya": "vidya",
    "overlap_t3": f"{-(_t3**3)!r} * a6 + {3 * (_t3**2 + _t3**3)!r} * a5 + {-3 * (2 * _t3**2 + _t3 + _t3**3)!r} * a4 + {1 + 3 * _t3 + _t3**3 + 3 * _t3**2!r} * a3", "overlap_supertrend": "case when bar_idx > 0 then case when st_side > 0 then st_lo else st_hi end end",
    "momentum_rsi": "rsi", "momentum_macd": "macd", "momentum_macd_signal": "signal", "momentum_macd_hist": "macd - signal", "momentum_ppo": f"100 * {_over('macd', 'c26')}", "momentum_apo": "macd", "momentum_trix": f"100 * ({_over('x3', lag('x3'))} - 1)",
    "momentum_tsi": f"100 * {_over('p2', 'q2')}", "momentum_pvo": f"100 * {_over('v12 - v26', 'v26')}", "momentum_stochrsi": _full(3, "avg", "stoch"), "momentum_cmo": f"100 * {_over('gain - loss', 'gain + loss')}", "momentum_kdj_k": "kk", "momentum_kdj_d": "kd", "momentum_kdj_j": "3 * kk - 2 * kd",
    "momentum_fisher": "fish", "momentum_eri_bull": "high - c13", "momentum_eri_bear": "low - c13", "momentum_pgo": _over(f"case when {roll('max(close)', 14)} > {roll('min(close)', 14)} then close - {_full(14, 'avg', 'close')} else 0.0 end", "tr14"), "momentum_smi": _over("s2", "u2"), "momentum_smi_signal": "smi_signal", "momentum_smi_osc": f"{_over('s2', 'u2')} - smi_signal",
    "momentum_inertia": "(" + " + ".join(f"{w!r} * {lag('rvi', k) if k else 'rvi'}" for k, w in enumerate(fitted(20))) + ")", "momentum_squeeze": _full(6, "avg", "mom12"), "momentum_stc_macd": "macd",
    "trend_adx": "adx", "trend_dmp": f"100 * {_over('plus', 'atr')}", "trend_dmn": f"100 * {_over('minus', 'atr')}", "trend_psar": "case when bar_idx > 0 then sar end", "trend_decay": "decay", "trend_cksp_long": _full(9, "max", "ck_long"), "trend_cksp_short": _full(9, "min", "ck_short"),
    "volume_efi": "efi", "volume_adosc": "ad3 - ad10", "volume_kvo": "sv34 - sv55", "volume_aobv": "ob4 - ob12", "candles_ha_open": "ha_o", "candles_ha_close": "hac",
}
CHECKED = tuple(f"ta_{k}" for k in _CELLS)
_SQL = _BEFORE + walk("walked", "m2", _inputs, _S) + _AFTER
over_bars("features_technical_recursive", lambda b: TA.recursive_indicators(b).select(*KEYS, *CHECKED), {f"ta_{k}": f"coalesce({x}, 0.0)" for k, x in _CELLS.items()}, _SQL, "w1", 4)
over_bars("features_technical_paths", lambda b: TA.recursive_indicators(b).drop(*CHECKED))

# Over bars that begin with a gap: what is smoothed starts with the first value by itself; what starts with a first bar is walked from the first known one.
_STARTS = ("overlap_kama", "overlap_ssf", "overlap_hwma", "overlap_vidya", "overlap_supertrend", "trend_psar", "trend_decay", "candles_ha_open")
_cell = lambda k: f"round((coalesce({_CELLS[k]}, 0.0))::double + 3e-7, 4) + 0.0 as ta_{k}"
_rest = [k for k in _CELLS if k not in _STARTS]
query("features_technical_recursive_gapped", f"with recursive {GAPPED}{_SQL} select series_id, bar_idx, {', '.join(map(_cell, _rest))} from w1")(
    lambda s, p: rounded(TA.recursive_indicators(gapped_bars_of(s, p)).select(*KEYS, *[f"ta_{k}" for k in _rest]), 4)
)
_KNOWN = """starts as (select series_id, min(bar_idx) as start from whole_bars where close is not null group by 1),
bars as (select * exclude (start) replace (bar_idx - start as bar_idx) from whole_bars join starts using (series_id) where bar_idx >= start)"""
query("features_technical_starts_gapped", f"""with recursive {WHOLE_GAPPED}, {_KNOWN}{_SQL} select series_id, bar_idx + start as bar_idx, {', '.join(map(_cell, _STARTS))} from w1 join starts using (series_id)
union all select series_id, bar_idx, {', '.join('0.0::double' for _ in _STARTS)} from whole_bars join starts using (series_id) where bar_idx < start""")(
    lambda s, p: rounded(TA.recursive_indicators(gapped_bars_of(s, p)).select(*KEYS, *[f"ta_{k}" for k in _STARTS]), 4)
)
