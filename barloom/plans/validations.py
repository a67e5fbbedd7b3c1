"""Queries of the catalog and of validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import catalog as C
from barloom.operators import features as FT
from barloom.operators import scores as S
from barloom.operators import validation as V
from barloom.operators.exprs import KEYS, by_time, div
from barloom.plans import _CLASSIFICATION, _DEALT, _PREDS, _prefix_sql, preds
from barloom.sources.membership import Membership
from barloom.sources.shared import fresh_path
from barloom.plans.base import bars_of, kept, lead, over_bars, query, rounded, table

# ---- catalog ---------------------------------------------------------------------------------------------------------

#: category, indicator, text, doc: rows that each rule has something to say about, beside those the events make.
_ROWS = (
    ("momentum", "rsi", "(bars)", "relative strength"), ("trend", "zigzag", "(bars)", None), ("trend", "Ichimoku", "(bars)", "cloud"), ("overlap", "sma", "(bars, length)", "centered window"), ("overlap", "ema", "(bars)", "smoothed"),
    ("cycles", "ebsw", "(bars)", None), ("volume", "obv", "()", "balance"), ("volume", "lead", "(bars)", None), ("statistics", "misleading", "(bars)", "leader shifts"), ("volatility", "atr", "(bars)", "repaints nothing"), ("candles", "doji", None, None),
)
_VALUES = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in _ROWS)
_MANY = f"""rows_ as (select category, indicator, text, doc from (values {_VALUES}) r(category, indicator, text, doc)
  union all select case event_type when 'click' then 'momentum' when 'view' then 'cycles' else 'trend' end, 'made_' || event_id, case when event_id % 11 = 0 then '()' else '(bars)' end, case when event_id % 7 = 0 then 'uses a shift of the series' when event_id % 5 = 0 then 'plots forwards' else 'plain' end from events)"""
_BAD = "regexp_matches(lower(concat_ws(' ', indicator, text, doc)), '\\b(forward|lead|centered|center|repaint|repainting|repaints|future|shift)\\b') or lower(indicator) in ('zigzag', 'fractal', 'ichimoku')"


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(c, i, t, ["bars"] if t else None, d) for c, i, t, d in _ROWS], C.SCHEMA)
    k = F.col("event_id")
    made = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", "momentum").when(F.col("event_type") == "view", "cycles").otherwise("trend").alias("category"), F.concat(F.lit("made_"), k.cast("string")).alias("indicator"),
        F.when(k % 11 == 0, "()").otherwise("(bars)").alias("text"), F.array(F.lit("bars")).alias("params"), F.when(k % 7 == 0, "uses a shift of the series").when(k % 5 == 0, "plots forwards").otherwise("plain").alias("doc"),
    )
    return fixed.unionByName(made)


_VERDICT = f"verdicts as (select category, indicator, case when category not in ('momentum', 'overlap', 'trend', 'volume', 'statistics', 'candles') then 'excluded' when {_BAD} then 'lookahead' else 'kept' end as verdict from rows_ where text is not null and text <> '()')"
query("catalog_filtered", f"with {_MANY}, {_VERDICT} select * from verdicts")(lambda s, p: C.filtered(catalog_rows(s, p)))
query("catalog_counts", f"with {_MANY}, {_VERDICT} select category, count(*) filter (verdict = 'kept') as kept, count(*) filter (verdict = 'lookahead') as lookahead, count(*) filter (verdict = 'excluded') as excluded from verdicts group by 1")(
    lambda s, p: C.counts(catalog_rows(s, p))
)

# ---- validation ------------------------------------------------------------------------------------------------------

_GRADE = "5 * (0.6 * greatest(0, least(1, 1 - abs(auc_perm - 0.5) / 0.1)) + 0.4 * greatest(0, least(1, 1 - abs(ap_perm - base) / greatest(0.05, 1 - least(0.99, base)))))"
_METRICS = _CLASSIFICATION[: _CLASSIFICATION.rindex("select s.run_id")]
query("validation_permutation", f"""with {_PREDS.replace('preds as', 'drawn as', 1)}, {_DEALT}, {_METRICS}, got as (select s.run_id, a as auc_perm, ap as ap_perm, m / f.c as base from s join f using (run_id)), graded as (select *, {_GRADE} as grade from got)
select run_id, round(auc_perm + 3e-7, 6) as auc_perm, round(ap_perm + 3e-7, 6) as ap_perm, round(base + 3e-7, 6) as baseline_pos_rate, round(grade + 3e-7, 6) as grade, ['very poor', 'poor', 'acceptable', 'good', 'excellent'][least(floor(grade), 4)::int + 1] as label from graded""")(
    lambda s, p: rounded(V.permutation_test(preds(s, p)))
)


def folded_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preds(spark, sf_dir).withColumn("fold", (F.col("row_id") % 4).cast("int"))


_FOLDED = f"{_PREDS.replace('preds as', 'all_preds as', 1)}, preds as (select run_id || '|' || (row_id % 4) as run_id, row_id, y, p from all_preds), {_METRICS}"
_PER_FOLD = "per_fold as (select split_part(s.run_id, '|', 1) as run_id, split_part(s.run_id, '|', 2)::int as fold, f.c as n_test, m / f.c as pos_rate, a as auc, ap from s join f using (run_id) where f.c >= 50 and a is not null)"
query("validation_folds", f"with {_FOLDED}, {_PER_FOLD} select run_id, fold, n_test, round(pos_rate + 3e-7, 6) as pos_rate, round(auc + 3e-7, 6) as auc, round(ap + 3e-7, 6) as ap from per_fold")(lambda s, p: rounded(V.by_fold(folded_preds(s, p))))
_QS = ", ".join(f"round(quantile_cont({c}, {q}) + 3e-7, 6) as {c}_{n}" for c in ("auc", "ap") for n, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75)))
query("validation_walk_forward", f"with {_FOLDED}, {_PER_FOLD} select run_id, count(*) as folds, {_QS} from per_fold group by 1")(lambda s, p: rounded(V.walk_forward(V.by_fold(folded_preds(s, p)))))

#: A run's folds, of which two have one class only, summed up as rf and hgb runs are.
_RUN_FOLDS = f"""{_FOLDED.replace("row_id, y, p from all_preds)", "row_id, case row_id % 4 when 3 then 0 else y end as y, p from all_preds where row_id % 4 > 0 or y = 1)")}"""
_SUMS = ", ".join(f"round({e} + 3e-7, 6) + 0.0 as {n}" for n, e in {
    "auc": "quantile_cont(auc, 0.5)", "auc_median": "quantile_cont(auc, 0.5)", "auc_mean": "avg(auc)", "auc_q025": "quantile_cont(auc, 0.025)", "auc_q975": "quantile_cont(auc, 0.975)",
    "ap": "quantile_cont(ap, 0.5)", "ap_mean": "avg(ap)", "pos_rate_test": "quantile_cont(pos_rate, 0.5)",
}.items())


def fold_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = folded_preds(spark, sf_dir)
    return d.where("fold > 0 or y = 1").withColumn("y", F.when(F.col("fold") == 3, 0).otherwise(F.col("y")))


query("run_folds", f"""with {_RUN_FOLDS}, per_fold as (select split_part(s.run_id, '|', 1) as run_id, f.c as n_test, m / f.c as pos_rate, case when isfinite(a) then a end as auc, case when isfinite(ap) then ap else 0 end as ap from s join f using (run_id))
select run_id, {_SUMS}, count(auc) as folds, sum(n_test)::bigint as n_test from per_fold group by 1""")(lambda s, p: rounded(S.fold_summary(S.over_folds(fold_preds(s, p)))))  # fmt: skip


def multiclass_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("p"), F.col("row_id") * 37 % 101 / 101
    return preds(spark, sf_dir).select("run_id", "row_id", (F.col("row_id") * 7 % 3).cast("int").alias("label"), F.array(p, (1 - p) * q, (1 - p) * (1 - q)).alias("p"))


_MULTI = f"""{_PREDS.replace('preds as', 'all_preds as', 1)}, multi as (select run_id, row_id, row_id * 7 % 3 as label, p as p0, (1 - p) * ((row_id * 37 % 101) / 101) as p1, (1 - p) * (1 - (row_id * 37 % 101) / 101) as p2 from all_preds),
preds as (select run_id || '|' || c as run_id, row_id, (label = c)::int as y, case c when 0 then p0 when 1 then p1 else p2 end as p from multi, (values (0), (1), (2)) v(c)), {_METRICS}"""
query("metrics_multiclass", f"""with {_MULTI}, macro as (select split_part(s.run_id, '|', 1) as run_id, avg(a) as auc, avg(ap) as ap, max(f.c)::bigint as n, count(*)::int as classes from s join f using (run_id) group by 1),
hits as (select run_id, avg((label = case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end)::int) as accuracy from multi group by 1)
select run_id, round(auc + 3e-7, 6) as auc, round(ap + 3e-7, 6) as ap, n, classes, round(accuracy + 3e-7, 6) as accuracy from macro join hits using (run_id)""")(lambda s, p: rounded(S.multiclass(multiclass_preds(s, p))))  # fmt: skip

_LONG = f"{B.BARS_SQL}, targets as (select case when {lead('close', 5)} is not null then ({lead('close', 5)} > close)::int::double end as up_5, {lead('close', 5)} / nullif(close, 0) - 1 as move_5 from bars), long as (select 'up_5' as name, up_5 as x from targets union all select 'move_5', move_5 from targets)"


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.lead("close", 5).over(by_time())
    return bars_of(spark, sf_dir).select(*KEYS, F.when(ahead.isNotNull(), (ahead > F.col("close")).cast("int")).alias("up_5"), (div(ahead, "close") - 1).alias("move_5"))


_D = ", ".join(f"round({x} + 3e-7, 6) + 0.0 as {n}" for n, x in (("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("min", "min(x)"), ("q25", "quantile_cont(x, 0.25)"), ("q50", "quantile_cont(x, 0.5)"), ("q75", "quantile_cont(x, 0.75)"), ("max", "max(x)")))
query("validation_described", f"""with {_LONG} select name as "column", count(x) as count, round(count(x) / count(*) + 3e-7, 6) as non_null_ratio, {_D} from long group by 1""")(lambda s, p: rounded(V.described(moves(s, p), ["up_5", "move_5"])))
query("validation_coverage", f"with {_LONG} select name as target, round(avg((x is not null)::int) + 3e-7, 6) as coverage, round(avg(coalesce(x, 0)) + 3e-7, 6) + 0.0 as positive_rate from long group by 1")(
    lambda s, p: rounded(V.coverage(moves(s, p), ["up_5", "move_5"]))
)
over_bars(
    "view_normalized", lambda b: V.normalized_like(b, "volume", "close", "like_close").select(*KEYS, "like_close"),
    {"like_close": "case when max(volume) over p = min(volume) over p then (max(close) over p - min(close) over p) / 2 else (volume - min(volume) over p) / (max(volume) over p - min(volume) over p) * (max(close) over p - min(close) over p) end".replace("over p", "over (partition by series_id)")},
)
query("view_color_bounds", f"with {B.BARS_SQL}, x as (select open as x from bars union all select close from bars) select round(quantile_cont(x, 0.05) + 3e-7, 6) as vmin, round(quantile_cont(x, 0.95) + 3e-7, 6) as vmax from x")(
    lambda s, p: rounded(V.color_bounds(bars_of(s, p), ["open", "close"]))
)


def _by_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = kept(bars_of(spark, sf_dir), "bars")
    names = ["pct_change", "momentum_3", "volume_change", "vol_sum_1d_cal", "vol_sum_1d_roll"]
    return rounded(V.by_checkpoint(b, lambda x: FT.momentum(x).join(FT.volume(x), list(KEYS)), names))


def _checkpoint_sql() -> str:
    out, heads = _prefix_sql((0.5, 0.7, 0.9), apart=True), []
    for k, c in enumerate(("0_50", "0_70", "0_90")):
        heads.append(f"round(count(*) filter (part = {k} and coalesce(abs(a - b) > 1e-9, (a is null) <> (b is null))) / count(*) filter (part = {k}) + 3e-7, 6) + 0.0 as mismatch_{c}")
    return f"{out} select feature, {', '.join(heads)} from compared group by 1"


query("audit_by_checkpoint", _checkpoint_sql())(_by_checkpoint)

_AUDITS = "audits as (select 'f_' || event_id as feature, (event_id % 100) / 100.0 as nan_rate, (event_id % 7) / 10.0 as prefix_mismatch_rate, (event_id % 13) / 20.0 as leak_score, case when event_id % 29 = 0 then 'x' end as error from events)"


def stored_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    d = table(spark, sf_dir, "events").select(
        F.concat(F.lit("f_"), k.cast("string")).alias("feature"), (k % 100 / 100.0).alias("nan_rate"), (k % 7 / 10.0).alias("prefix_mismatch_rate"), (k % 13 / 20.0).alias("leak_score"), F.when(k % 29 == 0, "x").alias("error")
    )
    return d.withColumns({"flag_prefix": F.col("prefix_mismatch_rate") > 0, "flag_leak": F.col("leak_score") > 0.2})


query("audit_listing", f"with {_AUDITS} select feature, round(nan_rate + 3e-7, 6) as nan_rate, round(prefix_mismatch_rate + 3e-7, 6) as prefix_mismatch_rate, round(leak_score + 3e-7, 6) as leak_score, case when error is not null then 'error' when prefix_mismatch_rate > 0 or leak_score > 0.2 then 'suspicious' else 'ok' end as status from audits")(
    lambda s, p: rounded(V.audit_listing(stored_audits(s, p)))
)
_ID = """sha256('{"code_hash":"c1","extra":"' || event_type || '","name":"n' || (event_id % 50) || '","params":{"k":' || (event_id % 3) || '}}')"""
query("entity_ids_unseen", f"select distinct {_ID} as id from events where {_ID} not in (select {_ID} from events where event_id % 2 = 0 and event_id % 50 < 25)")(
    lambda s, p: V.unseen(_ids(table(s, p, "events")).distinct(), _ids(table(s, p, "events").where("event_id % 2 = 0 and event_id % 50 < 25")))
)


def _unseen_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by a stored filter of the known ids, built from two halves."""
    events = table(spark, sf_dir, "events")
    known = _ids(events.where("event_id % 2 = 0 and event_id % 50 < 25"))
    path = fresh_path(spark, "membership")
    halves = [Membership.create(spark, f"{path}/{k}", 100_000, 0.01) for k in range(2)]
    for k, half in enumerate(halves):
        half.add(known.where(F.crc32("id") % 2 == k), "id")
    halves[0].merge(halves[1])
    return halves[0].unseen(_ids(events).distinct(), known.distinct(), "id")


query("entity_ids_filtered", f"select distinct {_ID} as id from events where {_ID} not in (select {_ID} from events where event_id % 2 = 0 and event_id % 50 < 25)")(_unseen_by_filter)


def _ids(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(V.entity_id(F.concat(F.lit("n"), (k % 50).cast("string")), F.struct((k % 3).alias("k")), F.lit("c1"), F.col("event_type")).alias("id"))

