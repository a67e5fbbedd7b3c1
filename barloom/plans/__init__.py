"""Registered queries over the driver's tables, and DuckDB SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import dependence as D
from barloom.operators import experiments as E
from barloom.operators import features as FT
from barloom.operators import history as H
from barloom.operators import scores as S
from barloom.operators import staged as SG
from barloom.operators import targets as T
from barloom.operators import technical as TA
from barloom.operators.exprs import KEYS, by_time, div
from barloom.plans import indicators, recurrences  # noqa: F401  register their queries
from barloom.plans.base import gapped_bars_of, ORACLES, PRICES, QUERIES, W, bars_of, d, kept, lag, lead, over_bars, query, roll, rounded, spread, table, z  # noqa: F401
from barloom.sources.shared import fresh_path
from barloom.sources.store import Store
from barloom.streaming import bars as SB


@query("bars_gap_filled", f"with {B.BARS_SQL} select series_id, bar_idx, open, high, low, close, volume, n_trades, is_gap, is_gap as is_imputed_price, is_gap as is_imputed_volume, gap_len from bars")
def bars_gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir).select("series_id", "bar_idx", "open", "high", "low", "close", "volume", "n_trades", "is_gap", "is_imputed_price", "is_imputed_volume", "gap_len")


query("bars_gap_filled_gapped", f"with {B.GAPPED_BARS_SQL} select series_id, bar_idx, open, high, low, close, volume from bars")(
    lambda s, p: gapped_bars_of(s, p).select("series_id", "bar_idx", "open", "high", "low", "close", "volume")
)


def _extremes(bases: tuple[str, ...]) -> dict[str, str]:
    out = {}
    for label, n in FT.HORIZONS.items():
        for base in bases:
            if base != "close" and label in ("1d", "1w"):
                continue
            p, mx, mn = "" if base == "close" else f"{base}_", roll(f"max({base})", n), roll(f"min({base})", n)
            out |= {f"{p}dist_to_max_{label}_pct": z(d(f"{mx} - {base}", mx)), f"{p}dist_to_max_{label}_abs": z(f"{mx} - {base}"), f"{p}dist_to_min_{label}_pct": z(d(f"{base} - {mn}", mn)), f"{p}dist_to_min_{label}_abs": z(f"{base} - {mn}")}
            if base == "close":
                out[f"bars_since_max_{label}"] = f"bar_idx + struct_extract({roll("max({'x': close, 'i': -bar_idx})", n)}, 'i')"
                out[f"bars_since_min_{label}"] = f"bar_idx - struct_extract({roll("min({'x': close, 'i': bar_idx})", n)}, 'i')"
    return out


for _base, _digits in (("close", 6), ("hlc3", 6), ("vwap", 5)):
    _cols = _extremes((_base,))
    over_bars(f"features_extremes_{_base}", lambda b, base=_base: FT.extremes(b, (base,)), _cols, PRICES, "priced", _digits)

DAILY = f""",
days as (select *, date_trunc('day', ts) as day from bars),
daily as (select series_id, day, total, lag(total) over (partition by series_id order by day) as before, max(total) over (partition by series_id order by day rows 6 preceding) as week_max
          from (select series_id, day, round(sum(volume), 6) as total from days group by 1, 2)),
vols as (select series_id, bar_idx, total, before, week_max, round({roll('sum(volume)', 288)}, 6) as r from days join daily using (series_id, day))"""
over_bars("features_volume", FT.volume, {
    "vol_sum_1d_cal": "total", "vol_sum_1d_change_abs": z("total - before"), "vol_sum_1d_change_pct": z(d("total - before", "before")), "vol_sum_1w_max_cal": "week_max", "vol_sum_to_1w_max_abs": z("week_max - total"),
    "vol_sum_to_1w_max_pct": z(d("week_max - total", "week_max")), "vol_sum_1d_roll": "r", "vol_sum_1d_roll_change_abs": z(f"r - {lag('r')}"), "vol_sum_1d_roll_change_pct": z(f"{d('r', lag('r'))} - 1"),
}, DAILY, "vols", 5)

_minute, _dow = "(hour(ts) * 60 + minute(ts))", "(isodow(ts) - 1)"
over_bars("features_calendar", FT.calendar, {
    "tod_sin": f"sin(2 * pi() * {_minute} / 1440)", "tod_cos": f"cos(2 * pi() * {_minute} / 1440)", "dow_sin": f"sin(2 * pi() * {_dow} / 7)", "dow_cos": f"cos(2 * pi() * {_dow} / 7)", "is_weekend": f"({_dow} >= 5)", "hour_norm": "hour(ts) / 23.0",
    "is_month_start": "(day(ts) = 1)", "is_month_end": "(last_day(ts) = ts::date)", "is_quarter_start": "(date_trunc('quarter', ts)::date = ts::date)", "is_quarter_end": "(last_day(date_trunc('quarter', ts) + interval 2 month) = ts::date)",
}, ints=("is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end"))

_full = f"case when {roll('count(close)', 5)} >= 5 then"
over_bars("features_momentum", FT.momentum, {
    "pct_change": z(f"{d('close', lag('close'))} - 1"), "momentum_3": z(f"close - {lag('close', 3)}"), "rolling_mean_5": f"first_value(m5 ignore nulls) over ({W} rows between current row and unbounded following)",
    "rolling_std_5": f"first_value(s5 ignore nulls) over ({W} rows between current row and unbounded following)", "volume_change": z(f"{d('volume', lag('volume'))} - 1"),
}, f", fives as (select *, {_full} {roll('avg(close)', 5)} end as m5, {_full} {roll('stddev_samp(close)', 5)} end as s5 from bars)", "fives", 5, gapped=True)


def _bands() -> tuple[str, dict[str, str]]:
    inner, out = [], {}
    for n in FT.CHANNELS:
        full = f"case when {roll('count(close)', n)} >= {n} then"
        inner.append(f"{full} {roll('avg(close)', n)} end as m{n}, {full} case when {roll('max(close)', n)} > {roll('min(close)', n)} then {roll('stddev_pop(close)', n)} end end as s{n}, {full} {roll('max(high)', n)} end as h{n}, {full} {roll('min(low)', n)} end as l{n}")
        clip = lambda x, k: z(f"case when {x} is not null then greatest(-{k}.0, least({k}.0, {x})) end")
        out |= {
            f"close_pos_bb_w{n}_k2": clip(f"(close - m{n}) / (4 * s{n})", 5), f"close_z_bb_w{n}_k2": clip(f"(close - m{n}) / (2 * s{n})", 10), f"close_pos_dc_w{n}": clip(d(f"close - (h{n} + l{n}) / 2", f"h{n} - l{n}"), 5),
            f"close_dist_sma_std_w{n}": clip(f"(close - m{n}) / s{n}", 10),
        }
    return f", banded as (select *, {', '.join(inner)} from bars)", out


_before, _cols = _bands()
over_bars("features_channels_window", FT.channels, _cols, _before, "banded", 4, gapped=True)
_cumulative = ("ta_volume_ad", "ta_volume_obv", "ta_volume_pvt")
_ta = TA.window_sql()
over_bars("features_technical_window", TA.window_indicators, {k: v for k, v in _ta.items() if k not in _cumulative}, TA.WINDOW_BEFORE, "stepped", 5)
over_bars("features_technical_cumulative", TA.cumulative_indicators, {k: _ta[k] for k in _cumulative}, TA.WINDOW_BEFORE, "stepped", 1)  # sums of up to 1e8: a tenth is 1e-9 of them
_totals = ("volume_nvi", "volume_pvi", *[k for k in SG.INDICATORS if "tos_stdevall" in k])
over_bars("features_technical_staged", lambda b: SG.indicators(b).drop(*[f"ta_{k}" for k in _totals]), {f"ta_{k}": f"coalesce({SG.plain(x)}, 0)" for k, x in SG.INDICATORS.items() if k not in _totals}, SG.stages_sql(), "stage2", 5)
over_bars("features_technical_totals", lambda b: SG.indicators(b).select(*KEYS, *[f"ta_{k}" for k in _totals]), {f"ta_{k}": f"coalesce({SG.plain(SG.INDICATORS[k])}, 0)" for k in _totals}, SG.stages_sql(), "stage2", 5)

_flag = lambda x: f"coalesce({x}, false)"
over_bars("targets_future", T.future, {
    "future_up": _flag(f"{lead('close')} > close"), "future_up_5": _flag(f"{lead('close', 5)} > close"), "future_up_20": _flag(f"{lead('close', 20)} > close"), "future_up_10bp_10": _flag(f"{d(lead('close', 10), 'close')} - 1 > 0.001"),
}, ints=("future_up", "future_up_5", "future_up_20", "future_up_10bp_10"))

_names = [f"updown_atr_H{h}_k{'05' if k == 0.5 else '1'}_nb025" for h, k in T.ATR_TARGETS]
_ud = lambda h, k: f"case when r{h} > {k} * a * sqrt({h}.0) then 1 when r{h} < -{k} * a * sqrt({h}.0) then 0 end"
over_bars("targets_atr", lambda b: T.atr_targets(b).select(*KEYS, *_names), {n: _ud(h, k) for n, (h, k) in zip(_names, T.ATR_TARGETS, strict=True)}, f""",
ranges as (select *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) as tr from bars),
atrs as (select *, case when {roll('count(tr)', 14)} >= 7 then {roll('avg(tr)', 14)} end / nullif(close, 0) as a, {', '.join(f"{lead('close', h)} / nullif(close, 0) - 1 as r{h}" for h in (6, 12, 36))} from ranges)""", "atrs", ints=tuple(_names))  # fmt: skip

# ---- scores ----------------------------------------------------------------------------------------------------------

SCORED = ("pct_change", "momentum_3", "volume_change")
_SCORED_SQL = f"""
feats as (select series_id, bar_idx, close, {z(f"{d('close', lag('close'))} - 1")} as pct_change, {z(f"close - {lag('close', 3)}")} as momentum_3, {z(f"{d('volume', lag('volume'))} - 1")} as volume_change,
                 {_flag(f"{lead('close')} > close")}::int::double as y from bars),
long as (select feature, x, y from (unpivot (select pct_change, momentum_3, volume_change, y from feats) on pct_change, momentum_3, volume_change into name feature value x) where x is not null),
ranked as (select *, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from long)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_of(spark, sf_dir)
    joined = FT.momentum(b).join(T.future(b).select(*KEYS, F.col("future_up").alias("y")), list(KEYS)).join(b.select(*KEYS, "close"), list(KEYS))
    return kept(joined, "scored")


@query("score_affinity", f"""with {B.BARS_SQL}, {_SCORED_SQL},
cells as (select feature, least(9, floor((rx - 1) * 10 / n)) as bx, least(9, floor((ry - 1) * 10 / n)) as byy, n, count(*) as c from (select *, count(*) over (partition by feature) as n from ranked) group by all),
mi as (select feature, sum(c / n * ln(c * n / (cx * cy)::double)) as mi_binned from (select *, sum(c) over (partition by feature, bx) as cx, sum(c) over (partition by feature, byy) as cy from cells) group by feature)
select r.feature, round(corr(x, y) + 3e-7, 6) + 0.0 as pearson, round(corr(rx, ry) + 3e-7, 6) + 0.0 as spearman, round(any_value(mi_binned) + 3e-7, 6) + 0.0 as mi_binned, count(*) as n_eff from ranked r join mi on r.feature = mi.feature group by r.feature""")  # fmt: skip
def score_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.affinity(scored(spark, sf_dir), list(SCORED), "y"))


_AVERAGE_RANK = "rank() over (partition by {0} order by {1}) + (count(*) over (partition by {0}, {1}) - 1) / 2.0"


@query("audit_leak_proxy", f"""with {B.BARS_SQL}, {_SCORED_SQL},
moves as (select series_id, bar_idx, pct_change, momentum_3, volume_change, {lead('r')} as r_next, {lag('r')} as r_past from (select *, {d('close', lag('close'))} - 1 as r from feats)),
pairs as (select feature, 'next' as kind, x, r_next as y from (unpivot moves on pct_change, momentum_3, volume_change into name feature value x) where r_next is not null
  union all select feature, 'past', x, r_past from (unpivot moves on pct_change, momentum_3, volume_change into name feature value x) where r_past is not null),
ranks as (select *, {_AVERAGE_RANK.format('feature, kind', 'x')} as rx, {_AVERAGE_RANK.format('feature, kind', 'y')} as ry from pairs where x is not null),
ics as (select feature, corr(rx, ry) filter (kind = 'next') as a, corr(rx, ry) filter (kind = 'past') as b from ranks group by 1)
select feature, round(a - b + 3e-7, 6) + 0.0 as leak_score, round(abs(a) - abs(b) + 3e-7, 6) + 0.0 as leak_score_abs from ics""")  # fmt: skip
def audit_leak_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.leak_scores(scored(spark, sf_dir), list(SCORED)))


_AUDITED = [*SCORED, "vol_sum_1d_cal", "vol_sum_1d_roll"]


def _prefix_sql(checkpoints: tuple[float, ...] = (0.6, 0.8, 0.9), apart: bool = False) -> str:
    """Each audited feature over all bars and over three prefixes, compared up to 50 bars before a prefix ends; apart: only up to the comparison's CTE."""
    made = lambda name, source: f"""{name}_days as (select *, date_trunc('day', ts) as day from {source}),
{name} as (select series_id, bar_idx, {z(f"{d('close', lag('close'))} - 1")} as pct_change, {z(f"close - {lag('close', 3)}")} as momentum_3, {z(f"{d('volume', lag('volume'))} - 1")} as volume_change,
  round(sum(volume) over (partition by series_id, day), 6) as vol_sum_1d_cal, round({roll('sum(volume)', 288)}, 6) as vol_sum_1d_roll from {name}_days)"""  # noqa: E731
    parts, compared = [made("whole", "bars")], []
    for k, f in enumerate(checkpoints):
        parts += [f"cut{k} as (select b.* from bars b join sizes using (series_id) where bar_idx < floor(n * {f}))", made(f"head{k}", f"cut{k}")]
        compared += [f"select '{c}' as feature, {k} as part, w.{c} as a, h.{c} as b from whole w join head{k} h using (series_id, bar_idx) join sizes using (series_id) where bar_idx < floor(n * {f}) - 50" for c in _AUDITED]
    before = f"""with {B.BARS_SQL}, sizes as (select series_id, count(*) as n from bars group by 1), {', '.join(parts)},
compared as ({' union all '.join(compared)})"""
    return before if apart else f"""{before}
select feature, count(*) as compared, count(*) filter (coalesce(abs(a - b) > 1e-9, (a is null) <> (b is null))) as changed, round(count(*) filter (coalesce(abs(a - b) > 1e-9, (a is null) <> (b is null))) / count(*) + 3e-7, 6) + 0.0 as mismatch_rate from compared group by 1"""


@query("audit_prefix_stability", _prefix_sql())
def audit_prefix_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = kept(bars_of(spark, sf_dir), "bars")
    make = lambda x: FT.momentum(x).join(FT.volume(x), list(KEYS))
    return rounded(S.prefix_stability(b, make, _AUDITED))


_HEALTH_SQL = f"""with {B.BARS_SQL},
y as (select series_id, bar_idx, {_flag(f"{lead('close', 5)} > close")}::int::double as y from bars),
l as (select *, {lag('y')} as p, row_number() over ({W}) as i from y),
runs as (select series_id, count(*) filter (y = 1) as ones, count(*) filter (y = 1 and coalesce(p, 0) <> 1) as k, min(i) filter (y = 1 and coalesce(p, 0) <> 1) as s0, max(i) filter (y = 1 and coalesce(p, 0) <> 1) as s1, count(*) as n, corr(y, p) as a from l group by 1),
modal as (select series_id, max(c) / sum(c) as const_rate from (select series_id, y, count(*) as c from y group by 1, 2) group by 1),
q as (select series_id, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from y group by 1)
select y.series_id, round(avg((y is null)::int) + 3e-7, 6) + 0.0 as nan_rate, round(avg(case when q3 > q1 then (y < q1 - 5 * (q3 - q1) or y > q3 + 5 * (q3 - q1))::int else 0 end) + 3e-7, 6) + 0.0 as outlier_rate, round(avg(y) + 3e-7, 6) + 0.0 as pos_rate,
  round((max(y) - min(y)) / (abs(quantile_cont(y, 0.5)) + 1e-9) + 3e-7, 6) + 0.0 as range_rel, bool_and(y in (0, 1)) as is_binary,
  round(case when avg(y) > 0 then -avg(y) * log2(avg(y)) else 0 end + case when avg(y) < 1 then -(1 - avg(y)) * log2(1 - avg(y)) else 0 end + 3e-7, 6) + 0.0 as entropy_bits,
  round(any_value(const_rate) + 3e-7, 6) + 0.0 as const_rate, round(any_value(a) + 3e-7, 6) + 0.0 as acf_lag1, round(coalesce(any_value(ones) / nullif(any_value(k), 0), 0.0) + 3e-7, 6) + 0.0 as avg_event_len,
  round(case when any_value(k) = 0 then 0 when any_value(k) = 1 then 1.0 / any_value(n) else (any_value(k) - 1) / (any_value(s1) - any_value(s0)) end + 3e-7, 6) + 0.0 as label_density
from y join runs using (series_id) join modal using (series_id) join q using (series_id) group by y.series_id"""


@query("score_target_health", _HEALTH_SQL)
def score_target_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.target_health(T.future(bars_of(spark, sf_dir)), "future_up_5"))


def _target_sql(y: str) -> str:
    """All of a target's scores per series, for y over bars."""
    r = lambda x, name: f"round({x} + 3e-7, 6) + 0.0 as {name}"
    real = lambda x: f"case when not isnan({x}) then {x} end"
    return f"""with {B.BARS_SQL},
y as (select series_id, bar_idx, close, ({y})::double as y from bars),
rets as (select *, {d(lag('close'), lag('close', 2))} - 1 as ret_1, {d(lag('close'), lag('close', 4))} - 1 as ret_3, {d(lag('close'), lag('close', 13))} - 1 as ret_12, {d(lead('close'), 'close')} - 1 as ret_next from y),
pairs as (select series_id, kind, x, y from (unpivot rets on ret_1, ret_3, ret_12, ret_next into name kind value x) where x is not null and y is not null),
ranks as (select *, {_AVERAGE_RANK.format('series_id, kind', 'x')} as rx, {_AVERAGE_RANK.format('series_id, kind', 'y')} as ry from pairs),
ic as (select series_id, kind, abs({real('corr(rx, ry)')}) as ic from ranks group by 1, 2 having count(*) >= 50),
ics as (select series_id, max(ic) filter (kind = 'ret_1') as ic_ret_1, max(ic) filter (kind = 'ret_3') as ic_ret_3, max(ic) filter (kind = 'ret_12') as ic_ret_12, max(ic) filter (kind = 'ret_next') as ic_next, quantile_cont(ic, 0.5) filter (kind <> 'ret_next') as ic_median from ic group by 1),
l as (select *, {lag('y')} as p, row_number() over ({W}) as i, count(*) over (partition by series_id) as n, avg(y) over (partition by series_id) as m from y where y is not null),
shape as (select series_id, count(*) as n, avg(y) as pos_rate, bool_and(y in (0, 1)) as bin, (max(y) - min(y)) / (avg(abs(y)) + 1e-12) as range_rel, avg((y - m) ** 3) / nullif(var_pop(y) ** 1.5, 0) as skew, avg((y - m) ** 4) / nullif(var_pop(y) ** 2, 0) - 3 as kurtosis, {real('corr(y, p)')} as acf,
  count(*) filter (y = 1) as ones, count(*) filter (y = 1 and coalesce(p, 0) <> 1) as k, min(i) filter (y = 1 and coalesce(p, 0) <> 1) as s0, max(i) filter (y = 1 and coalesce(p, 0) <> 1) as s1, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from l group by 1),
modal as (select series_id, max(c) / sum(c) as const_rate from (select series_id, y, count(*) as c from l group by 1, 2) group by 1),
halves as (select series_id, y, count(*) filter (i <= n // 2) as a, count(*) filter (i > n // 2) as b from l where n >= 200 group by 1, 2),
ks as (select series_id, max(gap) as ks from (select series_id, abs(sum(a) over u / sum(a) over w - sum(b) over u / sum(b) over w) as gap from halves window u as (partition by series_id order by y), w as (partition by series_id)) group by 1),
basic as (select series_id, avg((y is null)::int) as nan_rate, avg(case when y is not null then case when q3 > q1 then (y < q1 - 5 * (q3 - q1) or y > q3 + 5 * (q3 - q1))::int else 0 end end) as odd from y join shape using (series_id) group by 1),
t as (select *, case when pos_rate in (0, 1) then 'inf'::double else greatest(pos_rate, 1 - pos_rate) / greatest(1e-12, least(pos_rate, 1 - pos_rate)) end as ratio,
  case when pos_rate > 0 then -pos_rate * log2(pos_rate) else 0 end + case when pos_rate < 1 then -(1 - pos_rate) * log2(1 - pos_rate) else 0 end as bits, coalesce(ones / nullif(k, 0), 0.0) as len,
  case when k = 0 then 0 when k = 1 then 1.0 / n else (k - 1) / (s1 - s0) end as density, ic_next - ic_ret_1 as leak
  from basic join shape using (series_id) join modal using (series_id) left join ks using (series_id) left join ics using (series_id)),
h as (select *, 1 - 0.7 * nan_rate - 0.5 * greatest(0.0, const_rate - 0.95) - 0.3 * least(1.0, 2 * coalesce(odd, 0)) - 0.3 * least(1.0, coalesce(ks, 0))
  - case when bin then 0.8 * abs(pos_rate - 0.5) + case when pos_rate in (0, 1) then 0.3 else 0 end else case when range_rel < 0.1 then 0.2 else 0 end + case when abs(acf) < 0.02 then 0.1 else 0 end end
  + 0.2 * least(0.5, coalesce(ic_median, 0)) - case when leak > 0.2 then 0.4 else 0 end as health from t)
select series_id, {r('nan_rate', 'nan_rate')}, {r('const_rate', 'const_rate')}, {r('odd', 'outlier_rate_IQR')}, {r('ks', 'stability_ks')}, case when bin then 'clf' else 'reg' end as task_type,
  {', '.join(r(f'case when bin then {x} end', k) for k, x in {'pos_rate': 'pos_rate', 'class_ratio': 'ratio', 'entropy_bits': 'bits', 'avg_event_len': 'len', 'label_density': 'density'}.items())},
  {', '.join(r(f'case when not bin and n >= 5 then {x} end', x) for x in ('range_rel', 'skew', 'kurtosis'))}, {r('case when not bin then acf end', 'acf_lag1')}, {r('case when not bin then acf end', 'acf_lagH')},
  {', '.join(r(x, x) for x in ('ic_ret_1', 'ic_ret_3', 'ic_ret_12', 'ic_median'))}, {r('leak', 'leakage_proxy_score')}, coalesce(leak > 0.2, false) as leakage_flag, {r('greatest(0.0, least(1.0, health))', 'health_score')} from h"""


@query("score_target_classes", _target_sql(f"case when {lead('close', 5)} is not null then ({lead('close', 5)} > close)::int end"))
def score_target_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.lead("close", 5).over(by_time()).isNotNull(), (F.lead("close", 5).over(by_time()) > F.col("close")).cast("int"))
    return rounded(S.target_scores(kept(bars_of(spark, sf_dir).select(*KEYS, "close", y.alias("y")), "target"), "y"))


@query("score_target_values", _target_sql(f"{lead('close', 5)} / nullif(close, 0) - 1"))
def score_target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = div(F.lead("close", 5).over(by_time()), "close") - 1
    return rounded(S.target_scores(kept(bars_of(spark, sf_dir).select(*KEYS, "close", y.alias("y")), "target"), "y"))


@query("score_target_ks", f"""with {B.BARS_SQL}, h as (select series_id, close, ntile(2) over ({W}) as h from bars where close is not null),
c as (select series_id, close, count(*) filter (h = 1) as a, count(*) filter (h = 2) as b from h group by 1, 2),
g as (select series_id, abs(sum(a) over u / sum(a) over p - sum(b) over u / sum(b) over p) as gap from c window u as (partition by series_id order by close), p as (partition by series_id))
select series_id, round(max(gap) + 3e-7, 6) + 0.0 as stability_ks from g group by 1""")  # fmt: skip
def score_target_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.ks_halves(bars_of(spark, sf_dir).select(*KEYS, "close"), "close"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by rule: one run for each event type, scores with ties."""
    e = table(spark, sf_dir, "events")
    p = (F.col("event_id") * 7919 % 100) / 100.0
    return e.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("row_id"), (F.col("event_id") * 31 % 10 < 3 + 4 * p).cast("int").alias("y"), p.alias("p"))


_PREDS = "preds as (select run_id, row_id, (row_id * 31 % 10 < 3 + 4 * p)::int as y, p from (select event_type as run_id, event_id as row_id, (event_id * 7919 % 100) / 100.0 as p from events))"


_CLASSIFICATION = f"""c as (select run_id, p, sum(y) as pos, count(*) as n, count(*) - sum(y) as neg from preds group by 1, 2),
k as (select *, sum(pos) over dn as tp, sum(neg) over dn as fp, sum(pos) over w as pp, sum(neg) over w as nn from c window dn as (partition by run_id order by p desc), w as (partition by run_id)),
v as (select run_id, max(pp)::double as m, max(nn)::double as n, sum(neg * (tp - pos / 2))::double / (max(pp) * max(nn)) as a, sum(pos * tp / (tp + fp)) / max(pp) as ap, max(abs(tp / pp - fp / nn)) as ks from k group by 1),
f as (select run_id, avg((greatest(0, least(1, p)) - y) ** 2) as brier, avg(((p >= 0.5)::int = y)::int) as accuracy, count(*) as c from preds group by 1),
r as (select *, row_number() over (partition by run_id order by p desc, row_id) as i, count(*) over (partition by run_id) as c from preds),
t as (select run_id, avg(y) filter (i <= greatest(1, floor(c * 0.01))) as p1, avg(y) filter (i <= greatest(1, floor(c * 0.05))) as p5, avg(y) filter (i <= greatest(1, floor(c * 0.1))) as p10 from r group by 1),
s as (select *, sqrt((a * (1 - a) + (m - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (m * n)) as se from v)
select s.run_id, f.c as n, s.m::bigint as n_pos, round(a + 3e-7, 6) as auc, round(greatest(0, a - 1.959963984540054 * se) + 3e-7, 6) as auc_lo, round(least(1, a + 1.959963984540054 * se) + 3e-7, 6) as auc_hi, round(ap + 3e-7, 6) as ap, round(ap / (m / f.c) + 3e-7, 6) as ap_lift, round(ks + 3e-7, 6) as ks,
  round(brier + 3e-7, 6) as brier, round(accuracy + 3e-7, 6) as accuracy, round(p1 + 3e-7, 6) as precision_at_1pct, round(p5 + 3e-7, 6) as precision_at_5pct, round(p10 + 3e-7, 6) as precision_at_10pct from s join f using (run_id) join t using (run_id)"""


@query("metrics_classification", f"with {_PREDS}, {_CLASSIFICATION}")
def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.classification(preds(spark, sf_dir)))


@query("metrics_threshold", f"""with {_PREDS}, c as (select run_id, count(*) filter (p >= 0.5 and y = 1) as tp, count(*) filter (p >= 0.5 and y = 0) as fp, count(*) filter (p < 0.5 and y = 0) as tn, count(*) filter (p < 0.5 and y = 1) as fn from preds group by 1)
select *, round(coalesce(tp / nullif(tp + fp, 0), 0) + 3e-7, 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0) + 3e-7, 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + 3e-7, 6) as f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) + 3e-7, 6) as mcc, round((tp + tn) / (tp + fp + tn + fn) + 3e-7, 6) as accuracy from c""")  # fmt: skip
def metrics_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.at_threshold(preds(spark, sf_dir)))


@query("metrics_best_f1", f"""with {_PREDS}, c as (select run_id, p, sum(y) as pos, count(*) as n from preds group by 1, 2),
f as (select run_id, p, round(2 * sum(pos) over dn / (sum(n) over dn + sum(pos) over w), 12) as f1 from c window dn as (partition by run_id order by p desc), w as (partition by run_id))
select run_id, p as threshold, round(f1 + 3e-7, 6) as f1 from (select *, row_number() over (partition by run_id order by f1 desc, p desc) as i from f) where i = 1""")  # fmt: skip
def metrics_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.best_f1(preds(spark, sf_dir)))


_REG = "reg as (select run_id, y, p, avg(y) over (partition by run_id) as y_train_mean from (select event_type as run_id, value as y, value * 0.8 + event_id % 11 as p from events))"


@query("metrics_regression", f"""with {_REG}, r as (select *, rank() over (partition by run_id order by y) + (count(*) over (partition by run_id, y) - 1) / 2.0 as ry, rank() over (partition by run_id order by p) + (count(*) over (partition by run_id, p) - 1) / 2.0 as rp from reg),
g as (select run_id, avg((y - p) ** 2) as mse, avg(abs(y - p)) as mae, var_pop(y) as v, avg((y - y_train_mean) ** 2) as b, corr(ry, rp) as s from r group by 1)
select run_id, round(sqrt(mse) + 3e-7, 5) as rmse, round(mae + 3e-7, 5) as mae, round(1 - mse / v + 3e-7, 5) as r2, round(sqrt(b) + 3e-7, 5) as baseline_rmse, round(1 - sqrt(mse) / sqrt(b) + 3e-7, 5) as skill_rmse, round(1 - mse / v + 3e-7, 5) as skill_var, round(s + 3e-7, 5) as spearman from g""")  # fmt: skip
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("value").alias("y"), (F.col("value") * 0.8 + F.col("event_id") % 11).alias("p"))
    return rounded(S.regression(e.join(e.groupBy("run_id").agg(F.avg("y").alias("y_train_mean")), "run_id")), 5)


_DEALT = """given as (select run_id, row_id, p, row_number() over (partition by run_id order by row_id) as i from drawn), labels_ as (select run_id, y, row_number() over (partition by run_id order by md5('42:' || row_id), row_id) as i from drawn),
preds as (select g.run_id, row_id, y, p from given g join labels_ l on g.run_id = l.run_id and g.i = l.i)"""


@query("metrics_permutation", f"with {_PREDS.replace('preds as', 'drawn as', 1)}, {_DEALT}, {_CLASSIFICATION}")
def metrics_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.classification(E.permuted(preds(spark, sf_dir))))


# ---- history ---------------------------------------------------------------------------------------------------------


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.shredded(H.synthetic_runs(spread(table(spark, sf_dir, "orders"))))


_Q = "round(quantile_cont({0}, {1}) + 3e-7, 6)::double"


def _quality_sql(by: list[str], runs: str, least: int = 1) -> str:
    q = lambda c, p=0.5: _Q.format(c, p)
    return f"""with {H.SHREDDED_SQL}, r as (select *, ap / nullif(pos_rate_test, 0) as lift from shredded)
    select {', '.join(by)}, {runs} as runs, {q('auc')} as auc_median, {q('auc', 0.025)} as auc_q025, {q('auc', 0.975)} as auc_q975, round(quantile_cont(auc, 0.75) - quantile_cont(auc, 0.25) + 3e-7, 6) as auc_iqr, {q('accuracy')} as acc_median, {q('ap')} as ap_median,
    {q('pos_rate_test')} as pos_rate_median, {q('lift')} as ap_lift_median, {q('fit_time_sec')} as fit_median, {q('predict_time_sec')} as pred_median from r group by {', '.join(by)} having {runs} >= {least}"""


query("history_by_target", _quality_sql(["target"], "count(auc)", 3))(lambda s, p: rounded(H.quality(runs_of(s, p), ["target"], 3, finite_only=True)))
query("history_by_target_model", _quality_sql(["target", "model"], "count(*) filter (has_auc)"))(lambda s, p: rounded(H.quality(runs_of(s, p), ["target", "model"])))
query("history_by_model", _quality_sql(["model"], "count(*) filter (has_auc)"))(lambda s, p: rounded(H.quality(runs_of(s, p), ["model"])))
query("history_status_counts", "select case when o_orderstatus = 'P' then 'FAILED' else 'SUCCESS' end as status, count(*) as count from orders group by 1")(lambda s, p: H.synthetic_runs(table(s, p, "orders")).groupBy("status").count())
query("history_recent_runs", "select o_orderkey as run_id, case when o_orderstatus = 'P' then 'FAILED' else 'SUCCESS' end as status, strftime(o_orderdate, '%Y-%m-%d') as started_at from orders order by started_at desc, run_id limit 20")(
    lambda s, p: H.synthetic_runs(table(s, p, "orders")).select("run_id", "status", "started_at").orderBy(F.desc("started_at"), "run_id").limit(20)
)
query("history_k_quality", f"""with {H.SHREDDED_SQL}, r as (select *, ap / nullif(pos_rate_test, 0) as lift from shredded)
select k, model, target, count(*) as runs, {_Q.format('auc', 0.5)} as auc_median, round(quantile_cont(auc, 0.75) - quantile_cont(auc, 0.25) + 3e-7, 6) as auc_iqr, {_Q.format('ap', 0.5)} as ap_median, {_Q.format('lift', 0.5)} as ap_lift_median from r group by grouping sets ((k), (k, model), (k, target))""")(lambda s, p: rounded(H.k_quality(runs_of(s, p))))  # fmt: skip
query("history_failures", f"with {H.SHREDDED_SQL} select feature, count(*) as fails, count(*)::double as fail_rate from (select unnest(failed) as feature from shredded) group by 1")(lambda s, p: H.failures(runs_of(s, p)))

_SCORE = "case when auc is null or n_test > 0 and n_test < 30 then null else greatest(0, least(1, 2 * (auc - 0.5))) end"
_UNIFIED = "greatest(0, least(1, 2 * (auc - 0.5)))"
query("leaderboard_top_runs", f"with {H.SHREDDED_SQL} select run_id, target, model, k, round({_UNIFIED} + 3e-7, 6) as score, 'clf' as task from shredded where auc is not null and regexp_matches(target, '(?i)UP_') order by {_UNIFIED} desc, run_id limit 25")(lambda s, p: rounded(H.top_runs(runs_of(s, p), 25, "UP_")))
query("leaderboard_top_normalized", f"""with {H.SHREDDED_SQL} select run_id, target, model, k, round(score + 3e-7, 6) as score, 'clf' as task from (select *, {_UNIFIED} * greatest(0, least(1, (ap - pos_rate_test) / (1 - pos_rate_test))) as score from shredded where auc is not null) order by score desc, run_id limit 25""")(lambda s, p: rounded(H.top_runs(runs_of(s, p), 25, normalize=True)))
query("leaderboard_best_per_target", f"""with {H.SHREDDED_SQL}, b as (select target, run_id, model, {_UNIFIED} as score from shredded where auc is not null), r as (select *, row_number() over (partition by target order by score desc, run_id)::int as rank, max(score) over (partition by target) as best from b)
select target, run_id, model, round(score + 3e-7, 6) as score, rank, round(best + 3e-7, 6) as best from r where rank <= 3""")(lambda s, p: rounded(H.best_per_target(runs_of(s, p))))  # fmt: skip

_AFF = """greatest(0.0, least(1.0, (0.5 * greatest(abs((o * 31 + i * 17) % 200 - 100) / 250, abs((o * 13 + i * 7) % 200 - 100) / 250) + 0.25 * least(1.0, ((o + i * 5) % 50 / 100) / 0.2) + 0.25 * least(1.0, (o * 3 + i) % 90 / 100))
   * greatest(0.3, least(1.0, (o % 400) / 200.0))))"""
_EVENTS = f"""{H.SHREDDED_SQL}, sc as (select *, {_SCORE} as score from shredded),
fe as (select run_id as o, unnest(range(0, k)) as i from sc),
ev as (select 'target' as kind, target as name, run_id as seq, score, false as failed from sc where score is not null union all select 'model', model, run_id, score, false from sc where score is not null
   union all select 'k', 'k_' || k, run_id, score, false from sc where score is not null
   union all select 'feature', 'feat_' || ((o + i * 3) % 60), o, case when o % 53 = 0 and i = 0 then 0.0 else {_AFF} end, o % 53 = 0 and i = 0 from fe)"""


def _folded(start: str, frozen: str = "false") -> str:
    """Weights after the events in ev, from start; scores of names for which frozen holds are left out."""
    later = "(partition by kind, name order by seq desc rows between unbounded preceding and 1 preceding)"
    return f"""ev2 as (select kind, name, seq, case when not ({frozen}) then score end as score, failed::int as f from ev),
ordered as (select *, coalesce(count(score) over {later}, 0) as ma, coalesce(sum(f) over {later}, 0) as fa from ev2),
folded as (select kind, name, power(0.8, count(score)) * power(0.5, sum(f)) as a, coalesce(sum(0.2 * score * power(0.8, ma) * power(0.5, fa + f)), 0) as b, count(score) as n, sum(score) as total, max(score) as best, arg_max(score, seq) filter (score is not null) as last from ordered group by 1, 2)"""


_WEIGHTS = f"""{_EVENTS}, {_folded("1.0")},
weights as (select kind, name, a + b as weight, n, total / n as mean, greatest(0, best) as best, last from folded)"""
query("weights_updated", f"with {_WEIGHTS} select kind, name, round(weight + 3e-7, 6) as weight, n, round(mean + 3e-7, 6) as mean, round(best + 3e-7, 6) as best, round(last + 3e-7, 6) as last from weights")(lambda s, p: rounded(H.weight_updates(H.run_events(runs_of(s, p)))))

_STORE = """store as (select 'feature' as kind, 'feat_' || range as name, case when range % 15 = 1 then 0.0 else 0.5 + range / 100 end as weight, range as n, 0.1 as mean, 0.2 as best, 0.05 as last, range % 10 = 0 as disabled from range(0, 64)
   union all select 'model', 'rf_baseline', 1.0, 0, 0.0, 0.0, null, true union all select 'target', 'future_up', 0.7, 3, 0.3, 0.9, 0.2, false)"""


def weight_store(spark: SparkSession) -> DataFrame:
    """A store by rule: some features disabled, some frozen by a weight of 0, a disabled model and a target with a past."""
    i = F.col("id")
    features = spark.range(0, 64).select(
        F.lit("feature").alias("kind"), F.concat(F.lit("feat_"), i.cast("string")).alias("name"), F.when(i % 15 == 1, 0.0).otherwise(0.5 + i / 100).alias("weight"), i.alias("n"), F.lit(0.1).alias("mean"), F.lit(0.2).alias("best"), F.lit(0.05).alias("last"),
        (i % 10 == 0).alias("disabled"),
    )
    schema = "kind string, name string, weight double, n long, mean double, best double, last double, disabled boolean"
    return features.union(spark.createDataFrame([("model", "rf_baseline", 1.0, 0, 0.0, 0.0, None, True), ("target", "future_up", 0.7, 3, 0.3, 0.9, 0.2, False)], schema))


query("weights_resumed", f"""with {_STORE}, {_EVENTS}, {_folded("", "(kind, name) in (select kind, name from store where disabled or weight <= 0)")}
select kind, name, round(coalesce(s.weight, 1.0) * coalesce(a, 1.0) + coalesce(b, 0.0) + 3e-7, 6) as weight, (coalesce(s.n, 0) + coalesce(f.n, 0))::bigint as n,
  round(coalesce((coalesce(s.mean, 0.0) * coalesce(s.n, 0) + coalesce(total, 0.0)) / nullif(coalesce(s.n, 0) + coalesce(f.n, 0), 0), 0.0) + 3e-7, 6) as mean, round(greatest(coalesce(s.best, 0.0), f.best) + 3e-7, 6) as best,
  round(coalesce(f.last, s.last) + 3e-7, 6) as last, coalesce(disabled, false) as disabled from store s full join folded f using (kind, name)""")(lambda s, p: rounded(H.weight_updates(H.run_events(runs_of(s, p)), weight_store(s))))  # fmt: skip


def _registry(spark: SparkSession) -> DataFrame:
    return spark.range(0, 70).select(F.lit("feature").alias("kind"), F.concat(F.lit("feat_"), F.col("id").cast("string")).alias("name"))


_RANK = "case when n <= 0 then 0 else greatest(0, least(1, (1 - exp(-n / 10.0)) * ({0} * mean + {1} * best + 0.1 * weight))) end"
query("leaderboard_features", f"""with {_WEIGHTS}, names as (select name from weights where kind = 'feature' union select 'feat_' || range from range(0, 70)),
t as (select name, coalesce(weight, 1.0) as weight, coalesce(n, 0) as n, coalesce(mean, 0.0) as mean, coalesce(best, 0.0) as best from names left join (select * from weights where kind = 'feature') using (name))
select name, round(weight + 3e-7, 6) as weight, n, round(mean + 3e-7, 6) as mean, round(best + 3e-7, 6) as best, round({_RANK.format(0.6, 0.3)} + 3e-7, 6) as rank from t""")(lambda s, p: rounded(H.component_table(H.weight_updates(H.run_events(runs_of(s, p))), _registry(s), "feature")))  # fmt: skip
query("leaderboard_targets", f"with {_WEIGHTS} select name, round(weight + 3e-7, 6) as weight, n, round(mean + 3e-7, 6) as mean, round(best + 3e-7, 6) as best, round({_RANK.format(0.7, 0.2)} + 3e-7, 6) as rank from weights where kind = 'target'")(lambda s, p: rounded(H.component_table(H.weight_updates(H.run_events(runs_of(s, p))), _registry(s), "target")))
_POOR = "case when target in ('future_up', 'future_up_20') then 0.45 + (run_id % 100) / 1000.0 else auc end", "case when target = 'future_up' or model = 'rf_baseline' then pos_rate_test * 1.01 else ap end"


def poor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs with some targets and models made too poor to keep, so that the rules have groups to find and groups to spare."""
    return runs_of(spark, sf_dir).withColumns({"auc": F.expr(f"case when auc is not null then {_POOR[0]} end"), "ap": F.expr(_POOR[1])})


query("pruning_groups", _quality_sql(["target", "model"], "count(*) filter (has_auc)").replace("from shredded)", f"from (select * replace (case when auc is not null then {_POOR[0]} end as auc, {_POOR[1]} as ap) from shredded))", 1)
      .replace("with ", "with raw_groups as (with ", 1) + ") select * from raw_groups where auc_median < 0.515 and (ap_lift_median is null or ap_lift_median < 1.02)")(
    lambda s, p: rounded(H.suggest_prune(H.quality(poor_runs(s, p), ["target", "model"])))
)
query("pruning_features", f"""with {_WEIGHTS} select name, n, round(mean + 3e-7, 6) as mean from (select * from weights where kind = 'feature' and n >= 80 and mean < 0.37 order by mean, n, name limit 50)""")(
    lambda s, p: rounded(H.suggest_features(H.weight_updates(H.run_events(runs_of(s, p))), mean=0.37).select("name", "n", "mean"))
)
_KEY = """'{"df":{"name":"events","split_id":"whole"},"eval":"default","features":[' || list_aggregate(list_transform(list_sort(features), lambda x: '"' || x || '"'), 'string_agg', ',') || '],"model":"' || model || '","seed":' || run_id || ',"target":"' || target || '"}'"""
query("history_run_keys", f"with {H.SHREDDED_SQL} select run_id, sha256({_KEY}) as run_key from shredded")(lambda s, p: H.synthetic_runs(table(s, p, "orders")).where("status = 'SUCCESS'").select("run_id", "run_key"))
query("run_keys_new", "select o_orderkey as run_id from orders where o_orderkey % 3 = 0 and not (o_orderkey % 2 = 0)")(
    lambda s, p: H.new_runs(H.synthetic_runs(table(s, p, "orders")).where("run_id % 3 = 0"), H.synthetic_runs(table(s, p, "orders")).where("run_id % 2 = 0")).select("run_id")
)
query("sample_weighted_features", f"with {_WEIGHTS} select name, round(weight + 3e-7, 6) as weight from weights where kind = 'feature' and weight > 0 order by -ln(1 - ('0x' || md5('42:' || name)[1:8])::bigint / 4294967296.0) / weight, name limit 8")(
    lambda s, p: rounded(H.sample_weighted(H.weight_updates(H.run_events(runs_of(s, p))).where("kind = 'feature'"), 8, 42).select("name", "weight"))
)


# ---- splits and models -----------------------------------------------------------------------------------------------


@query("splits_expanding", f"with {B.BARS_SQL} select series_id, fold::int as fold, (n - (5 - fold) * (n // 6))::bigint as train_end, (n - (5 - fold) * (n // 6))::bigint as test_start, (n - (4 - fold) * (n // 6))::bigint as test_end from (select series_id, count(*) as n from bars group by 1), range(0, 5) t(fold)")
def splits_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folds(bars_of(spark, sf_dir))


@query("splits_walk_forward", f"with {B.BARS_SQL}, f as (select series_id, fold::int as fold, greatest(0, n * fold // 5 - 12)::bigint as train_end, (n * fold // 5)::bigint as test_start, (n * (fold + 1) // 5)::bigint as test_end from (select series_id, count(*) as n from bars group by 1), range(0, 5) t(fold)) select * from f where train_end >= 100 and test_end - test_start >= 50")
def splits_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folds(bars_of(spark, sf_dir), 5, "walk", 12)


@query("model_logistic_metrics")
def model_logistic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.fit_and_score(scored(spark, sf_dir), list(SCORED), "y")
    return rounded(S.classification(p.select(F.lit("logistic_baseline").alias("run_id"), F.col("bar_idx").alias("row_id"), "y", "p")), 4)


@query("model_out_of_fold")
def model_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.out_of_fold(scored(spark, sf_dir), list(SCORED), "y", k=3), 4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to bars, features, a target, and each feature's affinity with it, best first."""
    b = bars_of(spark, sf_dir)
    feats = FT.momentum(b).join(FT.calendar(b), list(KEYS)).join(FT.volume(b), list(KEYS)).join(FT.extremes(b, ("close",), ("1d",)).select(*KEYS, "dist_to_max_1d_pct", "bars_since_max_1d"), list(KEYS))
    names = ["pct_change", "dist_to_max_1d_pct", "bars_since_max_1d", "vol_sum_1d_roll", "tod_sin"]
    joined = kept(feats.join(T.future(b).select(*KEYS, "future_up"), list(KEYS)).select(*KEYS, *names, "future_up"), "flagship")
    a = S.affinity(joined, names, "future_up").join(D.dependence(joined, names, "future_up").drop("n_eff"), "feature", "left")
    score = S.affinity_score(F.col("pearson"), F.col("spearman"), F.col("mi_knn"), F.col("dcor"), F.col("n_eff"))
    return rounded(a.withColumn("score", score).orderBy(F.desc("score"), "feature"))


query("flagship_feature_ranking")(flagship)


@query("score_dependence")
def score_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.dependence(scored(spark, sf_dir), list(SCORED), "y"))


@query("stream_closed_bars", f"""with {B.BARS_SQL} select series_id, ts::varchar as ts, open, high, low, close, volume, n_trades from raw
where ts + interval 5 minutes <= (select max(ts) - interval 10 minutes from events)""")  # fmt: skip
def stream_closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that a stream over events has closed when it has read all of them."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("event_type").alias("series_id"), "ts", "value")
    out, checkpoint = fresh_path(spark, "closed-bars"), fresh_path(spark, "closed-bars-checkpoint")
    SB.closed_bars(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("store_feature_matrix", f"""with {B.BARS_SQL} select series_id, bar_idx, close, round({z(f"{d('close', lag('close'))} - 1")} + 3e-7, 6) + 0.0 as pct_change,
(coalesce({lead('close', 5)} > close, false))::int as future_up_5 from bars""")  # fmt: skip
def store_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset, a feature and a target, each stored, read again and joined."""
    store = Store(spark, fresh_path(spark, "store"))
    store.save("events", bars_of(spark, sf_dir))
    bars = store.load("events")
    store.save_column("events", "feature", "pct_change", FT.momentum(bars))
    store.save_column("events", "target", "future_up_5", T.future(bars))
    x = bars.select(*KEYS, "close")
    for kind, name in (("feature", "pct_change"), ("target", "future_up_5")):
        x = x.join(store.load_column("events", kind, name), list(KEYS))
    return rounded(x)


from barloom.plans import searches, validations  # noqa: E402, F401  register their queries, with pieces from above
