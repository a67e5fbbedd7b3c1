"""Queries of the experiment engine: audits, selections over many seeds, and the ledger of a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import search
from barloom.operators import bars as B
from barloom.operators import features as FT
from barloom.operators import targets as T
from barloom.plans import _AUDITED, _AVERAGE_RANK, _prefix_sql, _STORE, weight_store
from barloom.plans.base import bars_of, d, kept, lag, lead, query, rounded
from barloom.registry import Registry
from barloom.sources.runs import RunLog
from barloom.sources.shared import fresh_path
from barloom.sources.store import Store
from barloom.sources.weights import WeightStore

# ---- audits ----------------------------------------------------------------------------------------------------------

_NAMES = ", ".join(_AUDITED)
_BEFORE, _, _STABLE = _prefix_sql().rpartition("select feature, count(*) as compared")
_AUDIT = f"""{_BEFORE.rstrip()}, stable as (select feature, count(*) as compared{_STABLE}),
moved as (select w.*, {lead('r')} as r_next, {lag('r')} as r_past from (select w.*, {d('close', lag('close'))} - 1 as r from (select whole.*, close from whole join bars using (series_id, bar_idx)) w) w),
pairs as (select feature, kind, x, y from (unpivot (unpivot moved on {_NAMES} into name feature value x) on r_next, r_past into name kind value y)),
ranks as (select *, {_AVERAGE_RANK.format('feature, kind', 'x')} as rx, {_AVERAGE_RANK.format('feature, kind', 'y')} as ry from pairs),
leaks as (select feature, corr(rx, ry) filter (kind = 'r_next') - corr(rx, ry) filter (kind = 'r_past') as leak from ranks group by 1),
nulls as (unpivot (select {', '.join(f'avg(({c} is null)::int) as {c}' for c in _AUDITED)} from whole) on {_NAMES} into name feature value nan_rate)
select feature, round(nan_rate + 3e-7, 6) + 0.0 as nan_rate, mismatch_rate as prefix_mismatch_rate, round(leak + 3e-7, 6) + 0.0 as leak_score, changed > 0 as flag_prefix, coalesce(leak > 0.2, false) as flag_leak from nulls join stable using (feature) left join leaks using (feature)"""


def audited_registry() -> Registry:
    """Five features, one of which looks ahead within its day, two targets and a model."""
    r = Registry()
    r.register_family("features", FT.momentum, [c for c in _AUDITED if not c.startswith("vol_")])
    r.register_family("features", FT.volume, [c for c in _AUDITED if c.startswith("vol_")])
    r.register_family("targets", T.future, ["future_up", "future_up_5"])
    r.register_model("logistic_baseline")
    r.register_eval_cfg("default", {"gap": 0})
    return r


@query("audit_features", _AUDIT)
def audit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.audit(kept(bars_of(spark, sf_dir), "bars"), audited_registry(), _AUDITED))


# ---- selections ------------------------------------------------------------------------------------------------------

SEEDS = 200
_TARGETS = ("future_up", "future_up_5", "future_up_20", "future_up_10bp_10")
_MODELS = {"tf_mlp_baseline": "clf", "hgb_baseline": "clf", "rf_baseline": "clf", "hgb_regressor": "reg"}
_u = lambda stage, name: f"('0x' || md5(seed || ':{stage}:' || {name})[1:8])::bigint / 4294967296.0"
_key = lambda stage, name, w: f"-ln(1 - {_u(stage, name)}) / ({w})"


def _selection_sql(targets: str, features: str, models: str, facts: str, least: int, most: int) -> str:
    """CTE chosen (seed, target, features, model) from CTE seeds; targets, features and models are selects of (name, w), facts of (name, n, ones)."""
    return f"""t as (select seed, name as target from (select seed, name, row_number() over (partition by seed order by {_key('target', 'name', 'w')}, name) as i from seeds, ({targets}) x) where i = 1),
f as ({features}), m as ({models}), facts as ({facts}),
bounds as (select seed, target, least({most}, (select count(*) from f), greatest(1, n // 8), case when ones > 0 then greatest(1, ones // 8) else {most} end)::bigint as most from t join facts on target = name),
k as (select seed, k from (select seed, k, row_number() over (partition by seed order by {_key('k', "'k_' || k", '1.0')}, 'k_' || k) as i from (select seed, unnest(range(least({least}, most), most + 1)) as k from bounds)) where i = 1),
drawn as (select seed, string_agg(name, ',' order by name) as features from (select seed, name, row_number() over (partition by seed order by {_key('feature', 'name', 'w')}, name) as i from seeds, f) join k using (seed) where i <= k group by 1),
mm as (select seed, name as model from (select seed, name, row_number() over (partition by seed order by {_key('model', 'name', "w * (0.5 + case when target = 'future_up' and name = 'hgb_baseline' then 0.8 else 0 end)")}, name) as i from t, m) where i = 1),
chosen as (select seed, target, features, model from t join drawn using (seed) join mm using (seed))"""


_FACTS = " union all ".join(f"select '{t}' as name, count(*) as n, sum({e}) as ones from leads" for t, e in {
    "future_up": "coalesce(l1 > close, false)::int", "future_up_5": "coalesce(l5 > close, false)::int", "future_up_20": "coalesce(l20 > close, false)::int", "future_up_10bp_10": "coalesce(l10 / nullif(close, 0) - 1 > 0.001, false)::int",
}.items())
_LEADS = f"leads as (select {', '.join(f'{lead("close", h)} as l{h}' for h in (1, 5, 10, 20))}, close from bars)"
_SELECTIONS = f"""with {B.BARS_SQL}, {_LEADS}, {_STORE}, seeds as (select range as seed from range(0, {SEEDS})),
{_selection_sql(
    "select x.name, coalesce(weight, 1.0) as w from (values " + ', '.join(f"('{t}')" for t in _TARGETS) + ") x(name) left join store s on s.kind = 'target' and s.name = x.name",
    "select name, weight * case when n >= 80 and mean < 0.05 then 0.1 else 1.0 end as w from store where kind = 'feature' and not disabled and weight > 0",
    "select name, 1.0 as w from (values ('tf_mlp_baseline'), ('hgb_baseline')) x(name)", _FACTS, 8, 20)}
select seed, target, features, model from chosen"""  # fmt: skip


@query("search_selections", _SELECTIONS)
def search_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selections that SEEDS seeds give with one store."""
    bars, weights, registry = bars_of(spark, sf_dir), WeightStore(disabled_models=["rf_baseline"], model_target_stats={"future_up": {"hgb_baseline": {"mean": 0.8}}}), Registry()
    for r in weight_store(spark).where("kind = 'feature'").collect():
        weights.features[r["name"]] = r["weight"]
        weights.features_stats[r["name"]] = {"n": r["n"], "mean": r["mean"]}
        if r["disabled"]:
            weights.disabled_features.append(r["name"])
    weights.targets["future_up"] = 0.7
    registry.register_family("targets", T.future, _TARGETS)
    registry.register_family("features", FT.momentum, sorted(weights.features))
    for name, task in _MODELS.items():
        registry.register_model(name, task)
    made = kept(T.future(bars), "targets")
    facts = {t: search.facts(made, t) for t in _TARGETS}
    rows = []
    for seed in range(SEEDS):
        s = search.build_selection(registry, weights, facts.__getitem__, seed)
        rows.append((seed, s["target"], ",".join(s["features"]), s["model"]))
    return spark.createDataFrame(rows, "seed long, target string, features string, model string")


# ---- a loop ----------------------------------------------------------------------------------------------------------

RUNS = 2
_LEDGER = f"""with {B.BARS_SQL}, {_LEADS}, seeds as (select range as seed from range(0, {RUNS})),
{_selection_sql("select * from (values ('future_up', 1.0), ('future_up_5', 1.0)) x(name, w)", "select unnest(" + repr([c for c in _AUDITED if c != "vol_sum_1d_cal"]) + ") as name, 1.0 as w", "select 'logistic_baseline' as name, 1.0 as w", _FACTS, 1, 3)}
select seed as run_no, target, features, model, 'SUCCESS' as status, sha256('{{"df":{{"name":"events","split_id":"whole"}},"eval":"default","features":["' || replace(features, ',', '","') || '"],"model":"' || model || '","seed":' || seed || ',"target":"' || target || '"}}') as run_key, true as scored, true as repeat_refused from chosen"""


@query("search_loop", _LEDGER)
def search_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop of RUNS runs over a stored dataset: features are audited, columns made and stored, models fitted, runs recorded.

    With alpha 0 the weights stay as they are, so SQL can say what each seed selects. A second loop finds all runs on record.
    """
    store = Store(spark, fresh_path(spark, "search-store"))
    store.save("events", bars_of(spark, sf_dir))
    lab = search.Lab(spark, store, RunLog(spark, fresh_path(spark, "search-runs")), audited_registry(), fresh_path(spark, "search-weights"))
    weights = WeightStore.load(spark, lab.weights_path)
    weights.toggle("model", "logistic_baseline", True)
    search.audit_candidates(store.load("events"), lab.registry, weights)
    ids, again = [], []
    for found in (ids, again):
        for seed in range(RUNS):
            selection = search.build_selection(lab.registry, weights, lambda t: lab.facts("events", t), seed, 1, 3)
            found.append(lab.run("events", "whole", selection, seed))
            if found[-1] is not None:
                lab.learn(found[-1], weights, alpha=0.0)
    weights.save(spark, lab.weights_path)
    order = spark.createDataFrame([(i, k, again[k] is None) for k, i in enumerate(ids)], "run_id string, run_no long, repeat_refused boolean")
    picked = F.from_json("selection_json", "target string, features array<string>, model string").alias("s")
    auc = F.get_json_object("metrics_json", "$.auc").cast("double")
    runs = lab.runs.runs().select("run_id", "run_key", "status", picked, (auc.between(0, 1) & (F.get_json_object("artifacts_json", "$.affinity") != "{}")).alias("scored"))
    return order.join(runs, "run_id").select("run_no", "s.target", F.array_join("s.features", ",").alias("features"), "s.model", "status", "run_key", "scored", "repeat_refused")
