"""Run history, weight store and search policy: leaderboards, quality tables, pruning, and the updates they drive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quantiles import quantiles, with_quantiles
from barloom.operators.scan import written
from barloom.operators.scores import affinity_score

METRICS = "auc double, auc_median double, ap double, accuracy double, pos_rate_test double, fit_time_sec double, predict_time_sec double, n_test int, skill double, r2 double, r2_score double, spearman double, pearson double"
SELECTION = "target string, features array<string>, model string, eval_cfg string"
ARTIFACTS = "failed_features array<struct<id: string, error: string>>, affinity map<string, struct<pearson: double, spearman: double, mi: double, dcor: double, n_eff: double>>"
ALPHA = 0.2


def run_key(df: Column, split_id: Column, target: Column, features: Column, model: Column, eval_cfg: Column, seed: Column) -> Column:
    """SHA-256 of the canonical form of what makes a run: features sorted, keys in order."""
    text = F.to_json(F.struct(F.struct(df.alias("name"), split_id.alias("split_id")).alias("df"), eval_cfg.alias("eval"), F.array_sort(features).alias("features"), model.alias("model"), seed.alias("seed"), target.alias("target")))
    return F.sha2(text, 256)


def new_runs(wanted: DataFrame, runs: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The wanted selections whose run_key isn't on record; failed runs count as on record unless they may be retried."""
    known = runs.where("status <> 'FAILED'") if retry_failed else runs
    return wanted.join(known.select("run_key"), "run_key", "left_anti")


def latest(log: DataFrame) -> DataFrame:
    """The last state of each run in an append-only log with a sequence number."""
    return log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), "seq").alias("r")).select("run_id", "r.*")


def shredded(runs: DataFrame) -> DataFrame:
    """run_id, started_at, target, model, k, features and the metrics (with failed_features) of successful runs; NaN becomes null, but has_auc tells it."""
    d = runs.where("status = 'SUCCESS' and metrics_json is not null")
    d = d.withColumns({"m": F.from_json("metrics_json", METRICS), "a": F.from_json("artifacts_json", ARTIFACTS)})
    # as rows of a list, so that the filter on what was parsed stays behind the parsing and doesn't do it once more
    d = d.withColumn("s", F.explode(F.array(F.from_json("selection_json", SELECTION)))).where("s.target is not null")
    value = lambda n: F.when(~F.isnan(f"m.{n}"), F.col(f"m.{n}"))
    names = [x.split()[0] for x in METRICS.split(", ")]
    cols = [(F.col(f"m.{n}") if n == "n_test" else value(n)).alias(n) for n in names]
    return d.select("run_id", "started_at", "s.target", "s.model", F.size("s.features").alias("k"), "s.features", *cols, F.col("m.auc").isNotNull().alias("has_auc"), "a.failed_features", "a.affinity")


def quality(runs: DataFrame, by: list[str], min_runs: int = 1, finite_only: bool = False) -> DataFrame:
    """Per group: runs and medians. With finite_only a run counts if its AUC is finite; else if it has one, NaN included."""
    n = F.count("auc") if finite_only else F.count_if(F.col("has_auc"))
    lift = F.try_divide("ap", F.nullif("pos_rate_test", F.lit(0.0)))
    medians = {"acc_median": "accuracy", "ap_median": "ap", "pos_rate_median": "pos_rate_test", "ap_lift_median": "_lift", "fit_median": "fit_time_sec", "pred_median": "predict_time_sec"}
    wanted = {"auc_median": ("auc", 0.5), "auc_q025": ("auc", 0.025), "auc_q975": ("auc", 0.975), "_q3": ("auc", 0.75), "_q1": ("auc", 0.25)} | {k: (c, 0.5) for k, c in medians.items()}
    d = written(runs.select(*by, "auc", "has_auc", "accuracy", "ap", "pos_rate_test", "fit_time_sec", "predict_time_sec", lift.alias("_lift")), "metrics")
    g = with_quantiles(d.groupBy(*by).agg(n.alias("runs")), by, quantiles(d, by, wanted, stored=True)).withColumn("auc_iqr", F.col("_q3") - F.col("_q1"))
    g = g.select(*by, "runs", "auc_median", "auc_q025", "auc_q975", "auc_iqr", *medians)
    return g.where(F.col("runs") >= min_runs).orderBy(F.desc_nulls_last("auc_median"), F.desc("runs"), *by)


def k_quality(runs: DataFrame) -> DataFrame:
    """The same medians by k, by (k, model) and by (k, target): each run is in a group of each kind."""
    lift, none, by = F.try_divide("ap", F.nullif("pos_rate_test", F.lit(0.0))), F.lit(None).cast("string"), ["k", "model", "target"]
    kinds = [F.struct(m.alias("model"), t.alias("target")) for m, t in ((none, none), (F.col("model"), none), (none, F.col("target")))]
    d = written(runs.select("k", "model", "target", "auc", "ap", lift.alias("_lift")), "metrics")
    d = d.select("k", "auc", "ap", "_lift", F.explode(F.array(*kinds)).alias("_kind")).select("k", "_kind.*", "auc", "ap", "_lift")
    found = quantiles(d, by, {"auc_median": ("auc", 0.5), "_q3": ("auc", 0.75), "_q1": ("auc", 0.25), "ap_median": ("ap", 0.5), "ap_lift_median": ("_lift", 0.5)}, stored=True)
    g = with_quantiles(d.groupBy(*by).agg(F.count("*").alias("runs")), by, found)
    return g.select(*by, "runs", "auc_median", (F.col("_q3") - F.col("_q1")).alias("auc_iqr"), "ap_median", "ap_lift_median")


def failures(runs: DataFrame) -> DataFrame:
    f = runs.select(F.explode("failed_features").alias("f")).groupBy(F.col("f.id").alias("feature")).agg(F.count("*").alias("fails"))
    return f.withColumn("fail_rate", F.col("fails").cast("double")).orderBy(F.desc("fails"), "feature")


def unit(c: Column) -> Column:
    """c held within 0 and 1; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def run_score() -> Column:
    """0 to 1 from the first metric that a run has; null where it was tested on fewer than 30 rows."""
    auc = F.coalesce("auc", "auc_median")
    c = F.coalesce(unit(2 * (auc - 0.5)), unit(F.col("skill")), unit(F.col("r2")), unit(F.col("r2_score")), unit((F.col("spearman") + 1) / 2), unit((F.col("pearson") + 1) / 2))
    return F.when((F.col("n_test") > 0) & (F.col("n_test") < 30), None).otherwise(c)


def unified_score(normalize: bool = False) -> Column:
    """The leaderboard's score; normalised, AUC skill times AP skill where both are known."""
    plain = F.coalesce(unit(2 * (F.coalesce("auc", "auc_median") - 0.5)), unit(F.col("skill")), unit(F.col("r2")), unit((F.col("spearman") + 1) / 2))
    if not normalize:
        return plain
    s_ap = unit(F.try_divide(F.col("ap") - F.col("pos_rate_test"), 1 - F.col("pos_rate_test")))
    return F.coalesce(unit(2 * (F.col("auc") - 0.5)) * s_ap, plain)


def top_runs(runs: DataFrame, k: int = 20, target_like: str | None = None, normalize: bool = False) -> DataFrame:
    """The k best runs. The filter on the target comes before the cut."""
    d = runs if target_like is None else runs.where(F.col("target").rlike(f"(?i){target_like}"))
    d = d.withColumn("score", unified_score(normalize)).where("score is not null").withColumn("task", F.when(F.coalesce("auc", "auc_median").isNotNull(), "clf").otherwise("reg"))
    return d.select("run_id", "target", "model", "k", "score", "task").orderBy(F.desc("score"), "run_id").limit(k)


def best_per_target(runs: DataFrame, n: int = 3) -> DataFrame:
    """The n best runs of each target, targets by their best. Best scores are found before ranks, so ranks see few rows each."""
    d = runs.withColumn("score", unified_score()).where("score is not null")
    w = Window.partitionBy("target").orderBy(F.desc("score"), "run_id")
    return d.withColumns({"rank": F.row_number().over(w), "best": F.max("score").over(Window.partitionBy("target"))}).where(F.col("rank") <= n).select("target", "run_id", "model", "score", "rank", "best").orderBy(F.desc("best"), "target", "rank")


CHUNK = 4096
PIECE_ROWS = 1 << 16


def _piece(events: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """One row for each chunk and name in some events in order: what they make of a weight of 0 (_w), counts of scores and failures, and the scores' total, best and last."""
    group = events.groupby(["_c", "kind", "name"], sort=False, dropna=False).ngroup().to_numpy()
    events = events.iloc[np.lexsort((events["score"].to_numpy(float), events["seq"].to_numpy(), group))]
    group = np.sort(group)
    m, f = events["m"].to_numpy(np.int64), events["f"].to_numpy(np.int64)
    score = np.where(m == 1, events["score"].to_numpy(float), 0.0)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], len(group)]
    behind = lambda x: np.repeat(np.cumsum(x)[end - 1], end - start) - np.cumsum(x)
    w = alpha * score * (1 - alpha) ** behind(m) * 0.5 ** (behind(f) + f)
    at = np.maximum.reduceat(np.where(m == 1, np.arange(len(m)), -1), start)
    add = lambda x: np.add.reduceat(x, start)
    found = {"_w": add(w), "m": add(m), "f": add(f), "total": add(score), "best": np.where(at < 0, np.nan, np.maximum.reduceat(np.where(m == 1, score, -np.inf), start)), "_last": np.where(at < 0, np.nan, score[at])}
    return events[["kind", "name", "seq"]].iloc[start].reset_index(drop=True).assign(**found)


def weight_updates(events: DataFrame, store: DataFrame | None = None, alpha: float = ALPHA, start: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """kind, name, weight, n, mean, best, last (and disabled, with a store) after (kind, name, seq, score, failed) events in order.

    A score moves a weight towards it, w -> (1 - alpha) w + alpha score, and a failure then halves it. Such steps compose: m
    scores and f failures turn w into (1 - alpha)^m w / 2^f plus a sum. So events are dealt by chunks of the sequence, sorted by it and
    folded a piece of a chunk at a time, and the pieces' results once more; no task holds all events of a name. Names that the store
    has disabled, or whose weight there is 0, are frozen: scores pass them by. Names without a score event keep what the store has.
    """
    events = events.withColumn("failed", F.coalesce("failed", F.lit(False)))
    if store is not None:
        frozen = store.where("kind <> 'k' and (disabled or weight <= 0)").select("kind", "name", F.lit(True).alias("_off"))
        events = events.join(frozen, ["kind", "name"], "left").withColumn("score", F.when(F.col("_off").isNull(), F.col("score"))).drop("_off")
    events = events.withColumns({"m": F.col("score").isNotNull().cast("int"), "f": F.col("failed").cast("int"), "_c": F.floor(F.col("seq") / chunk)})
    left = lambda of, m, f: F.pow(F.lit(1 - alpha), m) * F.pow(F.lit(0.5), f) * of
    zero = lambda c: F.coalesce(c, F.lit(0))

    def folded(d: DataFrame, by: list[str], order: str, part) -> DataFrame:
        """The share of each row's part that the scores and failures behind it leave."""
        later = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn("_w", left(part, zero(F.sum("m").over(later)), zero(F.sum("f").over(later))))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + len(batch)
            if rows >= PIECE_ROWS:
                yield _piece(pd.concat(held, ignore_index=True), alpha)
                held, rows = [], 0
        if rows:
            yield _piece(pd.concat(held, ignore_index=True), alpha)

    dealt = events.select("kind", "name", "seq", F.col("score").cast("double").alias("score"), "m", "f", "_c").repartition("_c").sortWithinPartitions("seq")
    seq = events.schema["seq"].dataType.simpleString()
    d = dealt.mapInPandas(pieces, f"kind string, name string, seq {seq}, _w double, m long, f long, total double, best double, _last double")
    d = d.withColumn("last", F.when(F.col("_last").isNotNull(), F.struct("seq", F.col("_last").alias("score"))))
    d = folded(d, ["kind", "name"], "seq", F.col("_w"))
    g = d.groupBy("kind", "name").agg(F.sum("_w").alias("_w"), F.sum("m").alias("m"), F.sum("f").alias("f"), F.sum("total").alias("total"), F.max("best").alias("best"), F.max("last").alias("last"))
    if store is None:
        d = g.withColumns({"n0": F.lit(0), "m0": F.lit(0.0), "b0": F.lit(0.0), "l0": F.lit(None).cast("double"), "w0": F.lit(start), "disabled": F.lit(False)})
    else:
        d = store.select("kind", "name", F.col("n").alias("n0"), F.col("mean").alias("m0"), F.col("best").alias("b0"), F.col("last").alias("l0"), F.col("weight").alias("w0"), "disabled").join(g, ["kind", "name"], "full")
        d = d.withColumns({"w0": F.coalesce("w0", F.lit(start)), "n0": zero("n0"), "m0": F.coalesce("m0", F.lit(0.0)), "b0": F.coalesce("b0", F.lit(0.0)), "disabled": F.coalesce("disabled", F.lit(False))})
    n = (F.col("n0") + zero("m")).cast("long")
    out = d.select(
        "kind", "name", (left(F.col("w0"), zero("m"), zero("f")) + F.coalesce("_w", F.lit(0.0))).alias("weight"), n.alias("n"),
        F.coalesce(F.try_divide(F.col("m0") * F.col("n0") + F.coalesce("total", F.lit(0.0)), n), F.lit(0.0)).alias("mean"), F.greatest("b0", "best").alias("best"), F.coalesce("last.score", "l0").alias("last"), "disabled",
    )
    return out if store is not None else out.drop("disabled")


def run_events(runs: DataFrame) -> DataFrame:
    """(kind, name, seq, score, failed) of successful runs.

    Targets, models and feature counts get the run's score, where it has one; each feature gets its own affinity score (0 where
    the run recorded none), and failed where it could not be computed.
    """
    found = "struct<pearson: double, spearman: double, mi: double, dcor: double, n_eff: double>"
    d = runs.withColumns({"score": run_score(), "_bad": F.coalesce(F.transform("failed_features", lambda x: x["id"]), F.array().cast("array<string>"))})
    row = lambda kind, name, score, a, failed: F.struct(F.lit(kind).alias("kind"), name.alias("name"), score.alias("score"), a.cast(found).alias("a"), failed.alias("failed"))
    no, none, nothing = F.lit(False), F.lit(None).cast("double"), F.lit(None)
    whole = F.array(row("target", F.col("target"), F.col("score"), nothing, no), row("model", F.col("model"), F.col("score"), nothing, no), row("k", F.concat(F.lit("k_"), F.col("k")), F.col("score"), nothing, no))
    own = F.transform("features", lambda f: row("feature", f, F.lit(0.0), F.try_element_at("affinity", f), F.array_contains("_bad", f)))
    absent = F.transform(F.array_except("_bad", "features"), lambda f: row("feature", f, none, nothing, F.lit(True)))
    kinds = F.concat(F.filter(whole, lambda x: x["score"].isNotNull()), own, absent)
    d = d.select(F.explode(kinds).alias("e"), F.col("run_id").alias("seq")).select("e.*", "seq")
    a = F.col("a")
    scored = F.when(a.isNotNull(), affinity_score(a["pearson"], a["spearman"], a["mi"], a["dcor"], a["n_eff"])).otherwise(F.col("score"))
    return d.select("kind", "name", "seq", scored.alias("score"), "failed")


def effective_weight(weight: Column, disabled: Column) -> Column:
    return F.when(F.coalesce(disabled, F.lit(False)), 0.0).otherwise(F.coalesce(weight, F.lit(1.0)))


def composite_rank(kind: Column, n: Column, mean: Column, best: Column, weight: Column) -> Column:
    """Confidence in n times a blend of mean, best and weight; targets and models lean more on the mean."""
    m, b, w = F.coalesce(mean, F.lit(0.0)), F.coalesce(best, F.lit(0.0)), F.coalesce(weight, F.lit(1.0))
    blend = F.when(kind == "feature", 0.6 * m + 0.3 * b + 0.1 * w).otherwise(0.7 * m + 0.2 * b + 0.1 * w)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.exp(-n / 10.0)) * blend)))


def component_table(weights: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """name, weight, n, mean, best, rank of a kind: those on record and, but for targets, those registered."""
    own = weights.where(F.col("kind") == kind)
    names = own.select("name") if kind == "target" else own.select("name").union(registry.where(F.col("kind") == kind).select("name")).distinct()
    d = names.join(own, "name", "left").select("name", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("best", F.lit(0.0)).alias("best"))
    return d.withColumn("rank", composite_rank(F.lit(kind), F.col("n"), F.col("mean"), F.col("best"), F.col("weight"))).orderBy(F.desc("rank"), F.desc("n"), F.desc("best"), "name")


def top_components(table: DataFrame, k: int = 10, unused: bool = False) -> DataFrame:
    return (table if unused else table.where("n > 0")).orderBy(F.desc("rank"), F.desc("n"), F.desc("best"), "name").limit(k)


def suggest_prune(groups: DataFrame) -> DataFrame:
    """Groups with a low median AUC and no lift."""
    return groups.where("auc_median < 0.515 and (ap_lift_median is null or ap_lift_median < 1.02)")


def suggest_features(weights: DataFrame, k: int = 50, n: int = 80, mean: float = 0.03) -> DataFrame:
    return weights.where(f"kind = 'feature' and n >= {n} and mean < {mean}").orderBy("mean", "n", "name").limit(k)


def cleanup(weights: DataFrame, registry: DataFrame) -> DataFrame:
    """The weights of what is still registered."""
    return weights.join(registry.select("kind", "name").distinct(), ["kind", "name"], "left_semi")


def bump(weights: DataFrame, names: list[str], set_weight: float | None = None, factor: float | None = None) -> DataFrame:
    """Set, multiply, or lift to 3 the weights of the named features; names that aren't there are added, from a weight of 1."""
    w = F.coalesce("weight", F.lit(1.0))
    new = F.lit(set_weight) if set_weight is not None else w * factor if factor is not None else F.greatest(w, F.lit(3.0))
    named = weights.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(names)], "name string").withColumn("kind", F.lit("feature"))
    added = named.join(weights.where("kind = 'feature'").select("name"), "name", "left_anti")
    both = weights.unionByName(added, allowMissingColumns=True)
    return both.withColumn("weight", F.when((F.col("kind") == "feature") & F.col("name").isin(names), new).otherwise(F.col("weight")))


def toggle(weights: DataFrame, kind: str, name: str, on: bool) -> DataFrame:
    hit = (F.col("kind") == kind) & (F.col("name") == name)
    return weights.withColumns({"weight": F.when(hit, F.lit(1.0 if on else 0.0)).otherwise(F.col("weight")), "disabled": F.when(hit, F.lit(not on)).otherwise(F.col("disabled"))})


def digest_uniform(seed: int | str, name: Column) -> Column:
    """A number in [0, 1) that seed and name decide, on any machine and in any order of rows."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_weighted(names: DataFrame, k: int, seed: int | str) -> DataFrame:
    """k names without replacement, each draw in proportion to weight (exponential keys); uniform if no weight is positive."""
    total = names.agg(F.sum("weight")).first()[0] or 0
    w = F.col("weight") if total > 0 else F.lit(1.0)
    return names.where(w > 0).withColumn("_key", -F.ln(1 - digest_uniform(seed, F.col("name"))) / w).orderBy("_key", "name").limit(k).drop("_key")


def without_leaks(features: DataFrame, target: str) -> DataFrame:
    """Features but those made from predictions of the target (or of one whose name starts with it)."""
    return features.where(~F.col("name").startswith(f"pred_{target}"))


RUNS_COLUMNS = "run_id, run_key, status, started_at, finished_at, selection_json, metrics_json, artifacts_json, error_msg"


def synthetic_runs(orders: DataFrame) -> DataFrame:
    """One run for each order, by rule: fixtures for the history queries."""
    k = F.col("o_orderkey")
    t = F.element_at(F.array(*[F.lit(x) for x in ("future_up", "future_up_5", "future_up_20", "future_up_10bp_10", "up_margin_H12_k075")]), (k % 5 + 1).cast("int"))
    m = F.element_at(F.array(*[F.lit(x) for x in ("hgb_baseline", "rf_baseline", "logistic_baseline")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    auc = 0.5 + ((k * 7919) % 1000) / 10000.0 - 0.01
    ap, pr = 0.3 + ((k * 104729) % 1000) / 2000.0, 0.2 + (k % 7) / 20.0
    feats = F.transform(F.sequence(F.lit(0), (k % 13 + 7).cast("int")), lambda i: F.concat(F.lit("feat_"), ((k + i * 3) % 60).cast("string")))
    metrics = F.concat(
        F.lit('{"auc": '), F.when(k % 97 == 0, "NaN").otherwise(F.round(auc, 6).cast("string")), F.lit(', "ap": '), F.round(ap, 6).cast("string"), F.lit(', "accuracy": '), F.round(auc * 0.9, 6).cast("string"),
        F.lit(', "pos_rate_test": '), F.round(pr, 6).cast("string"), F.lit(', "fit_time_sec": '), F.round((k % 50) / 10.0, 6).cast("string"), F.lit(', "predict_time_sec": '), F.round((k % 9) / 100.0, 6).cast("string"), F.lit(', "n_test": '), (k % 400).cast("string"), F.lit("}"),
    )
    broken = k % 53 == 0
    scores = lambda i: F.struct(
        (((k * 31 + i * 17) % 200 - 100) / 250).alias("pearson"), (((k * 13 + i * 7) % 200 - 100) / 250).alias("spearman"), ((k + i * 5) % 50 / 100).alias("mi"), ((k * 3 + i) % 90 / 100).alias("dcor"), (k % 400).cast("double").alias("n_eff")
    )
    known = F.filter(F.sequence(F.lit(0), (k % 13 + 7).cast("int")), lambda i: ~broken | (i > 0))
    affinity = F.map_from_arrays(F.transform(known, lambda i: F.concat(F.lit("feat_"), ((k + i * 3) % 60).cast("string"))), F.transform(known, scores))
    bad = F.when(broken, F.array(F.struct(F.concat(F.lit("feat_"), (k % 60).cast("string")).alias("id"), F.lit("x").alias("error"))))
    artifacts = F.to_json(F.struct(bad.alias("failed_features"), affinity.alias("affinity")))
    status = F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCESS")
    selection = F.to_json(F.struct(t.alias("target"), feats.alias("features"), m.alias("model"), F.lit("default").alias("eval_cfg")))
    return orders.select(
        k.alias("run_id"), run_key(F.lit("events"), F.lit("whole"), t, feats, m, F.lit("default"), k).alias("run_key"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("finished_at"), selection.alias("selection_json"), metrics.alias("metrics_json"), artifacts.alias("artifacts_json"), F.lit(None).cast("string").alias("error_msg"),
    )


SHREDDED_SQL = """
shredded as (select o_orderkey as run_id, strftime(o_orderdate, '%Y-%m-%d') as started_at,
    ['future_up', 'future_up_5', 'future_up_20', 'future_up_10bp_10', 'up_margin_H12_k075'][o_orderkey % 5 + 1] as target,
    ['hgb_baseline', 'rf_baseline', 'logistic_baseline'][o_custkey % 3 + 1] as model, (o_orderkey % 13 + 8)::int as k,
    list_transform(range(0, o_orderkey % 13 + 8), lambda i: 'feat_' || ((o_orderkey + i * 3) % 60)) as features,
    case when o_orderkey % 97 <> 0 then round(0.5 + ((o_orderkey * 7919) % 1000) / 10000.0 - 0.01, 6) end::double as auc,
    round(0.3 + ((o_orderkey * 104729) % 1000) / 2000.0, 6)::double as ap, round((0.5 + ((o_orderkey * 7919) % 1000) / 10000.0 - 0.01) * 0.9, 6)::double as accuracy,
    round(0.2 + (o_orderkey % 7) / 20.0, 6)::double as pos_rate_test, round((o_orderkey % 50) / 10.0, 6)::double as fit_time_sec, round((o_orderkey % 9) / 100.0, 6)::double as predict_time_sec,
    (o_orderkey % 400)::int as n_test, true as has_auc,
    case when o_orderkey % 53 = 0 then ['feat_' || (o_orderkey % 60)] else [] end as failed
  from orders where o_orderstatus <> 'P')"""
