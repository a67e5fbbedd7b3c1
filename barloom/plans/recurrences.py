"""Queries of smoothed and path-dependent families, and DuckDB SQL that walks each series bar by bar in a recursive table."""

from __future__ import annotations

import re

from barloom.operators import features as FT
from barloom.operators import targets as T
from barloom.operators.exprs import KEYS
from barloom.plans.base import PRICES, W, d, lag, lead, over_bars, roll, z


def walk(name: str, source: str, inputs: dict[str, str], states: dict[str, tuple[str, str]]) -> str:
    """CTEs `<name>_in` and `<name>` (series_id, bar_idx and the states after each bar).

    inputs: expressions over source. states: the value at the first bar, and at each later one from the values before. In
    both $x stands for an input at that bar and @y for a state that was listed before, as it is after that bar.
    """

    def at(text: str, place: str, mark: str) -> str:
        return re.sub(r"@(\w+)", rf"{mark}\1", re.sub(r"\$(\w+)", rf"in_\1[{place}]", text))

    first = ", ".join(f"{at(a, '1', '')} as {k}" for k, (a, _) in states.items())
    later = ", ".join(f"{at(b, 'bar_idx + 2', 'n_')} as n_{k}" for k, (_, b) in states.items())
    lists = ", ".join(f"list({x} order by bar_idx) as in_{k}" for k, x in inputs.items())
    return f""", {name}_in as (select series_id, count(*) as n, {lists} from {source} group by 1),
{name} as (select series_id, 0::bigint as bar_idx, {first} from {name}_in union all select e.series_id, bar_idx + 1, {later} from {name} e join {name}_in l on e.series_id = l.series_id where bar_idx + 1 < n)"""


def ema(y: str, x: str, alpha: float) -> tuple[str, str]:
    """A state: the first value that there is, then (1 - alpha) before + alpha now."""
    return f"({x})::double", f"coalesce({1 - alpha!r} * {y} + {alpha!r} * ({x}), {x}, {y})"


def span(n: int) -> float:
    return 2 / (n + 1)


def clipped(x: str, k: float) -> str:
    return z(f"case when {x} is not null then greatest(-{k}.0, least({k}.0, {x})) end")


TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"

# ---- bands and distances ---------------------------------------------------------------------------------------------

_states = {f"ema{n}": ema(f"ema{n}", "$close", span(n)) for n in FT.CHANNELS} | {f"atr{n}": ema(f"atr{n}", "$tr", span(n)) for n in FT.CHANNELS}
_sma = ", ".join(f"case when {roll('count(close)', n)} >= {n} then case when {roll('max(close)', n)} > {roll('min(close)', n)} then {roll('avg(close)', n)} else close end end as sma{n}" for n in FT.CHANNELS)
over_bars(
    "features_channels_smoothed", FT.channels_smoothed,
    {k: x for n in FT.CHANNELS for k, x in {
        f"close_pos_kc_w{n}_m2": clipped(d(f"close - ema{n}", f"4 * atr{n}"), 5), f"close_dist_ema_atr_w{n}": clipped(d(f"close - ema{n}", f"atr{n}"), 10), f"close_pos_atrband_w{n}_m2": clipped(d(f"close - sma{n}", f"4 * atr{n}"), 5),
    }.items()},
    walk("smooth", "bars", {"close": "close", "tr": "tr"}, _states).replace(", smooth_in as", f", ranges as (select *, {TRUE_RANGE} as tr, {_sma} from bars), smooth_in as", 1).replace("from bars group by 1", "from ranges group by 1")
    + ", smoothed as (select * from ranges join smooth using (series_id, bar_idx))", "smoothed", 6,
)

_states = {f"{b}{n}": ema(f"{b}{n}", f"${b}", span(n)) for b in ("hlc3", "vwap", "tr") for n in FT.DISTANCES}
over_bars(
    "features_other_distances", FT.other_distances,
    {f"{b}_dist_ema_atr_w{n}": clipped(d(f"{b} - {b}{n}", f"tr{n}"), 10) for b in ("hlc3", "vwap") for n in FT.DISTANCES},
    PRICES + f", ranges as (select *, {TRUE_RANGE} as tr from priced)" + walk("smooth", "ranges", {b: b for b in ("hlc3", "vwap", "tr")}, _states) + ", smoothed as (select * from ranges join smooth using (series_id, bar_idx))", "smoothed", 6,
)

_alpha = 1 - 2 ** (-1 / 30)
_names = list(FT.TRANSFORMED)
_bases = f""", days as (select *, date_trunc('day', ts) as day from bars), daily as (select series_id, day, round(sum(volume), 6) as total from days group by 1, 2),
based as (select series_id, bar_idx, {z(d(f"{roll('max(close)', 2016)} - close", roll('max(close)', 2016)))} as dist_to_max_1w_pct, {z(d(f"close - {roll('min(close)', 2016)}", roll('min(close)', 2016)))} as dist_to_min_1w_pct,
  {z(d(f"{roll('max(close)', 288)} - close", roll('max(close)', 288)))} as dist_to_max_1d_pct, first_value(s5 ignore nulls) over ({W} rows between current row and unbounded following) as rolling_std_5, total as vol_sum_1d_cal, round({roll('sum(volume)', 288)}, 6) as vol_sum_1d_roll
  from (select *, case when {roll('count(close)', 5)} >= 5 then {roll('stddev_samp(close)', 5)} end as s5 from days) join daily using (series_id, day)),
steps as (select *, {', '.join(f'{b} - {lag(b)} as d_{b}, {d(b, lag(b))} - 1 as p_{b}' for b in _names)} from based)"""
over_bars(
    "features_transforms", FT.native_transforms, {k: x for b in _names for k, x in {f"{b}_diff1": z(f"d_{b}"), f"{b}_pct1": z(f"p_{b}"), f"{b}_vel_ema": z(f"v_{b}")}.items()},
    _bases + walk("smooth", "steps", {f"d_{b}": f"d_{b}" for b in _names}, {f"v_{b}": ema(f"v_{b}", f"$d_{b}", _alpha) for b in _names}) + ", smoothed as (select * from steps join smooth using (series_id, bar_idx))", "smoothed", 6,
)

# ---- trend strength --------------------------------------------------------------------------------------------------

_w14 = 1 / 14
ADX = {"plus": ema("plus", "$up", _w14), "minus": ema("minus", "$down", _w14), "atr": ema("atr", "$tr", _w14)}
_dx = "case when @atr <> 0 and @plus + @minus <> 0 then 100 * abs(@plus - @minus) / (@plus + @minus) end"
ADX["adx"] = ema("adx", _dx, _w14)
MOVES = f""", moves as (select *, {TRUE_RANGE} as tr, case when high - {lag('high')} > {lag('low')} - low and high > {lag('high')} then high - {lag('high')} else 0.0 end as up,
  case when {lag('low')} - low > high - {lag('high')} and low < {lag('low')} then {lag('low')} - low else 0.0 end as down, close - {lag('close')} as change from bars)"""
_inputs = {"up": "up", "down": "down", "tr": "tr"}
_tau = f"case when {roll('count(tr)', 14)} >= 7 then {roll('avg(tr)', 14)} end / nullif(close, 0) * sqrt(12.0)"
_side = lambda k: f"case when r12 > {k} * tau then 1 when r12 < -{k} * tau then 0 end"
over_bars(
    "targets_atr_trend", lambda b: T.atr_targets(b).select(*KEYS, "trend_updown_atr_H12_k1_adx25", "mr_updown_atr_H12_k05_adx20"),
    {"trend_updown_atr_H12_k1_adx25": f"case when adx >= 25 then {_side(1)} end", "mr_updown_atr_H12_k05_adx20": f"case when adx <= 20 then {_side(0.5)} end"},
    MOVES + walk("strength", "moves", _inputs, ADX) + f", trends as (select *, {_tau} as tau, {lead('close', 12)} / nullif(close, 0) - 1 as r12 from moves join strength using (series_id, bar_idx))", "trends",
    ints=("trend_updown_atr_H12_k1_adx25", "mr_updown_atr_H12_k05_adx20"),
)

_strong = lambda c: f"greatest(0.0, least(100.0, 100 * coalesce(tau / sqrt(12.0), 0.0))) {c}"
over_bars(
    "targets_atr_trend_by_range", lambda b: T.atr_targets(b, by_range=True).select(*KEYS, "trend_updown_atr_H12_k1_adx25", "mr_updown_atr_H12_k05_adx20"),
    {"trend_updown_atr_H12_k1_adx25": f"case when {_strong('>= 25')} then {_side(1)} end", "mr_updown_atr_H12_k05_adx20": f"case when {_strong('<= 20')} then {_side(0.5)} end"},
    MOVES + f", trends as (select *, {_tau} as tau, {lead('close', 12)} / nullif(close, 0) - 1 as r12 from moves)", "trends", ints=("trend_updown_atr_H12_k1_adx25", "mr_updown_atr_H12_k05_adx20"),
)

_rsi = {"gain": ema("gain", "greatest($change, 0.0) + 0 * $change", _w14), "loss": ema("loss", "greatest(-$change, 0.0) + 0 * $change", _w14)}
_n = "l14_a14_w576_k3"
_wide = lambda f, least: f"case when {roll('count(r)', 576)} >= {least} then {roll(f, 576)} end"
over_bars(
    "features_rsi_regime", FT.rsi_regime,
    {"rsi_z_l14_w576": z("z"), "rsi_slope_z_l14_w576_k3": "slope", "rsi_rps_regime_a14": z("trend"), f"rsi_rps_{_n}": "score", f"rsi_rps_long_{_n}": f"coalesce(score > 0.5 and {lag('score')} <= 0.5, false)::int", f"rsi_rps_short_{_n}": f"coalesce(score < -0.5 and {lag('score')} >= -0.5, false)::int"},
    MOVES + walk("strength", "moves", _inputs | {"change": "change"}, ADX | _rsi) + f""",
rs as (select *, 100 * gain / nullif(gain + loss, 0) as r from moves join strength using (series_id, bar_idx)),
rs2 as (select *, r - {lag('r', 3)} as step from rs),
rs3 as (select *, (r - {_wide('avg(r)', 144)}) / nullif(greatest({_wide('stddev_pop(r)', 144)} - 1e-4, 0) + 1e-4, 1e-4) as z, coalesce(step / nullif(greatest(case when {roll('count(step)', 576)} >= 144 then {roll('stddev_pop(step)', 576)} end - 1e-4, 0) + 1e-4, 1e-4), 0.0) as slope,
  case when adx is not null then greatest(0.0, least(1.0, (adx - 20) / 5)) end as trend, {_wide('quantile_cont(r, 0.2)', 288)} as lo, {_wide('quantile_cont(r, 0.8)', 288)} as hi from rs2),
rs4 as (select *, coalesce(tanh(0.75 * ((2 * trend - 1) * ((2 * r - lo - hi) / nullif(hi - lo, 0)) + trend * 0.5 * slope)), 0.0) as score from rs3)""", "rs4", 6,
)

# ---- margins ---------------------------------------------------------------------------------------------------------

_a60 = 1 - 2 ** (-1 / 60)
#: Exponentially weighted mean and variance together; s2 is the sum of the squared weights, which are 1 in all.
_spread = {
    "mean": ("$r", f"case when mean is null then $r else {1 - _a60!r} * mean + {_a60!r} * $r end"),
    "cov": ("case when $r is not null then 0.0::double end", f"case when mean is null then case when $r is not null then 0.0::double end else {1 - _a60!r} * (cov + (mean - @mean) ** 2) + {_a60!r} * ($r - @mean) ** 2 end"),
    "s2": ("case when $r is not null then 1.0::double end", f"case when mean is null then case when $r is not null then 1.0 end else {(1 - _a60) ** 2!r} * s2 + {_a60**2!r} end"),
}
over_bars(
    "targets_margin", lambda b: T.margin(b, pass_infinite=False),
    {"up_margin_H12_k075": "case when rf is not null then (rf > tau)::int end", "updown_margin_H12_k075": "case when rf is null then null when rf > tau then 1 when rf < -tau then -1 else 0 end"},
    f", logs as (select *, ln(close / {lag('close')}) as r, ln({lead('close', 12)} / close) as rf from bars)" + walk("spread", "logs", {"r": "r"}, _spread)
    + ", margins as (select *, coalesce(0.75 * sqrt(12.0) * sqrt(case when s2 < 1 then cov / (1 - s2) end), 0.0) as tau from logs join spread using (series_id, bar_idx))", "margins", ints=("up_margin_H12_k075", "updown_margin_H12_k075"),
)

# ---- peaks and valleys -----------------------------------------------------------------------------------------------


def zigzag_sql(distance: int, threshold: float) -> str:
    """CTE pv: the artifact. The walk keeps the highest and lowest bar since the last extreme and the side that is looked for."""
    gone = f"($hi_v - $c) / abs($hi_v) * 100 >= {threshold} and $hi_v > 0"
    hi, lo = "case when $c > hv then bar_idx + 1 else hi end", "case when $c < lv then bar_idx + 1 else lo end"
    states = {
        "h0": ("0", hi), "hv0": ("$c", "greatest(hv, $c)"), "l0": ("0", lo), "lv0": ("$c", "least(lv, $c)"),
        "found": ("0", "case when side >= 0 and @h0 <= bar_idx and (" + gone.replace("$hi_v", "@hv0") + f" or bar_idx + 1 - @h0 >= {distance} and $c < @hv0) then 1 "
                  f"when side <= 0 and @l0 <= bar_idx and (($c - @lv0) / greatest(abs(@lv0), 1e-12) * 100 >= {threshold} or bar_idx + 1 - @l0 >= {distance} and $c > @lv0) then -1 else 0 end"),
        "mark": ("-1", "case @found when 1 then @h0 when -1 then @l0 else -1 end"), "side": ("0", "case @found when 1 then -1 when -1 then 1 else side end"),
        "hi": ("0", "case when @found <> 0 then bar_idx + 1 else @h0 end"), "hv": ("$c", "case when @found <> 0 then $c else @hv0 end"),
        "lo": ("0", "case when @found <> 0 then bar_idx + 1 else @l0 end"), "lv": ("$c", "case when @found <> 0 then $c else @lv0 end"),
    }
    ahead, behind = "rows between current row and unbounded following", "rows unbounded preceding"
    near = lambda f, k, side, rows: f"{f}(case when {k} then bar_idx end) over ({W} {rows})"  # noqa: E731, ARG005
    kinds = {"peak": 1, "valley": -1}
    cells = ", ".join(f"{near('min', k, s, ahead)} as next_{k}, {near('max', k, s, behind)} as prev_{k}" for k, s in kinds.items())
    prices = ", ".join(f"cs[{x} + 1]::double as c_{x}" for x in ("next_peak", "next_valley", "prev_peak", "prev_valley", "na", "nb"))
    return walk("zig", "bars", {"c": "close"}, states) + f""",
marks as (select distinct series_id, mark::bigint as bar_idx, found from zig where found <> 0),
placed as (select b.series_id, b.bar_idx, close as c, coalesce(found = 1, false) as peak, coalesce(found = -1, false) as valley, found is not null as any_mark from bars b left join marks using (series_id, bar_idx)),
near as (select *, {cells}, {near('max', 'any_mark', 0, behind)} as na, {near('min', 'any_mark', 0, ahead)} as nb, min(case when any_mark then bar_idx end) over (partition by series_id) as m0, max(case when any_mark then bar_idx end) over (partition by series_id) as m1 from placed),
priced_pv as (select *, {prices}, cs[m0 + 1] as c0, cs[m1 + 1] as c1 from near join (select series_id, list(close order by bar_idx) as cs from bars group by 1) using (series_id)),
pv as (select series_id, bar_idx, greatest((c_next_peak - c) / nullif(c, 0) + 0 * next_peak, case when next_peak is not null then 0.0 end) as up, greatest((c - c_next_valley) / nullif(c, 0) + 0 * next_valley, case when next_valley is not null then 0.0 end) as down,
  case when prev_valley is not null then greatest((c - c_prev_valley) / nullif(c_prev_valley, 0), 0.0) end as last_up, case when prev_peak is not null then greatest((c_prev_peak - c) / nullif(c_prev_peak, 0), 0.0) end as last_down,
  (next_peak - bar_idx)::double as to_next_peak, (next_valley - bar_idx)::double as to_next_valley, (bar_idx - prev_peak)::double as since_prev_peak, (bar_idx - prev_valley)::double as since_prev_valley, peak, valley,
  case when m0 is null then c when na is null then c0 when nb is null then c1 when nb = na then c_na else c_na + (c_nb - c_na) * (bar_idx - na) / (nb - na) end as line from priced_pv)"""


_numbers = ("up", "down", "last_up", "last_down", "to_next_peak", "to_next_valley", "since_prev_peak", "since_prev_valley", "line")
over_bars("pv_artifact", lambda b: T.peaks_and_valleys(b), {**{k: k for k in _numbers}, "peak": "peak", "valley": "valley"}, zigzag_sql(*T.PV_CONFIGS["pv_"]), "pv", raw=("peak", "valley"), gapped=(
    "bars as (select * replace (coalesce(close, first_value(close ignore nulls) over (partition by series_id order by bar_idx rows between current row and unbounded following)) as close) from whole_bars)"
))
_cut = lambda x: f"case when {x} is not null then greatest(-0.2, least(0.2, {x})) end"
over_bars("pv_features", lambda b: T.pv_features(T.peaks_and_valleys(b)), {
    "pv_last_up": "last_up", "pv_last_up_clip20": _cut("last_up"), "pv_last_down": "last_down", "pv_last_down_clip20": _cut("last_down"), "pv_since_prev_peak": "since_prev_peak", "pv_since_prev_valley": "since_prev_valley", "pv_last_trend": "last_up - last_down",
}, zigzag_sql(*T.PV_CONFIGS["pv_"]), "pv")


def family_sql(p: str) -> dict[str, str]:
    """The 37 targets over CTE pv and the one-row CTE caps."""
    flag = lambda x: f"coalesce({x}, false)::int"
    out = {f"{k}_ge_{t}pct": flag(f"{k} >= {v}") for k in ("up", "down") for t, v in (("0p5", 0.005), ("0p75", 0.0075), ("1", 0.01), ("1p5", 0.015), ("2", 0.02))}
    out |= {f"next_{k}_in_{h}": flag(f"to_next_{k} <= {h}") for k in ("peak", "valley") for h in (20, 50, 100, 200)}
    for a, b, sign in (("peak", "valley", "<="), ("valley", "peak", "<")):
        out[f"next_extreme_is_{a}"] = flag(f"to_next_{a} {sign} to_next_{b} or (to_next_{a} is not null and to_next_{b} is null)")
    out |= {f"last_{k}_ge_{t}pct": flag(f"last_{k} >= {v}") for k in ("up", "down") for t, v in (("0p5", 0.005), ("1", 0.01))}
    out |= {f"since_prev_{k}_ge_50": flag(f"since_prev_{k} >= 50") for k in ("peak", "valley")}
    out |= {"phase_up": flag("last_up >= last_down"), "phase_down": flag("last_down >= last_up")}
    some = lambda k, x: f"case when {k} is not null then {x} end"
    out |= {f"{k}_cont": some(k, f"least(greatest({k}, 0.0), cap_{k})") for k in ("up", "down", "last_up", "last_down")}
    out["line_cont"] = some("up - down", "greatest(-cap_line, least(up - down, cap_line))")
    out |= {f"tnext_{k}_log": some(f"to_next_{k}", f"least(ln(1 + greatest(to_next_{k}, 0.0)), cap_t{k})") for k in ("peak", "valley")}
    out["cycle_pos"] = "since_prev_valley / (since_prev_valley + to_next_peak + 1e-9)"
    out["phase_ratio"] = some("last_up + last_down", "greatest(last_up, 0.0) / (greatest(last_up, 0.0) + greatest(last_down, 0.0) + 1e-9)")
    return {f"{p}{k}": x for k, x in out.items()}


_caps = {"up": "up", "down": "down", "last_up": "last_up", "last_down": "last_down", "line": "abs(up - down)", "tpeak": "ln(1 + greatest(to_next_peak, 0.0) + 0 * to_next_peak)", "tvalley": "ln(1 + greatest(to_next_valley, 0.0) + 0 * to_next_valley)"}
_with_caps = f", caps as (select {', '.join(f'quantile_cont({x}, 0.99) as cap_{k}' for k, x in _caps.items())} from pv), family as (select * from pv, caps)"
for _p, (_distance, _threshold) in T.PV_CONFIGS.items():
    _cells = family_sql(_p)
    over_bars(
        f"targets_{_p}family", lambda b, p=_p, n=_distance, t=_threshold: T.pv_targets(T.peaks_and_valleys(b, n, t), p), _cells, zigzag_sql(_distance, _threshold) + _with_caps, "family",
        ints=tuple(k for k, x in _cells.items() if x.endswith("::int")),
    )
