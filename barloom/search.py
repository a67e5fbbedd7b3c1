"""The experiment engine: audits, selections drawn by weight, runs that are recorded, and the loop that learns from them.

A selection is a few names and is drawn on the driver; whatever touches bars is a DataFrame plan. Draws are decided by digests of
seed and name, so a seed gives the same selection on any machine.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import statistics
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import dependence as D
from barloom.operators import experiments as E
from barloom.operators import history as H
from barloom.operators import scores as S
from barloom.operators import validation as V
from barloom.operators.exprs import KEYS, finite
from barloom.operators.scan import written
from barloom.registry import Registry, compute
from barloom.sources.runs import RunLog
from barloom.sources.store import Store
from barloom.sources.weights import WeightStore

PREFERRED = {"tf_mlp_baseline": 3.0, "tf_mlp_bn_wd": 2.5, "hgb_baseline": 1.5, "logistic_baseline": 1.0}
DEFAULT_MODEL = "hgb_baseline"
LEAST_USES, POOR_MEAN, POOR_SHARE = 80, 0.05, 0.1


def draw(seed: int | str, weights: dict[str, float], k: int = 1) -> list[str]:
    """k names without replacement, each draw in proportion to weight; all alike where no weight is positive."""
    if sum(weights.values()) <= 0:
        weights = dict.fromkeys(weights, 1.0)

    def key(name: str) -> tuple[float, str]:
        u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) / 4294967296.0  # noqa: S324
        return -math.log(1 - u) / weights[name], name

    return sorted((n for n, w in weights.items() if w > 0), key=key)[:k]


# ---- audits ----------------------------------------------------------------------------------------------------------


def audit(bars: DataFrame, registry: Registry, names: list[str], checkpoints=(0.6, 0.8, 0.9), guard: int = 50, twice: bool = False) -> DataFrame:
    """feature, nan_rate, prefix_mismatch_rate, leak_score, flag_prefix, flag_leak of all the named features in three passes. twice: see prefix_stability."""
    make = lambda b: compute(b, {n: registry.get_feature(n) for n in names})
    both = make(bars).join(bars.select(*KEYS, "close"), list(KEYS))
    rates = both.agg(*[F.avg(finite(n).isNull().cast("int")).alias(n) for n in names])
    rates = rates.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("nan_rate")) for n in names])).alias("r")).select("r.*")
    stable = S.prefix_stability(bars, make, names, checkpoints, guard, twice).select("feature", F.col("mismatch_rate").alias("prefix_mismatch_rate"))
    out = rates.join(stable, "feature", "left").join(S.leak_scores(both, names).select("feature", "leak_score"), "feature", "left")
    above = lambda c, limit: F.coalesce(F.col(c) > limit, F.lit(False))
    return out.withColumns({"flag_prefix": above("prefix_mismatch_rate", 0.0), "flag_leak": above("leak_score", 0.2)})


def audit_candidates(bars: DataFrame, registry: Registry, weights: WeightStore, stored=lambda: None) -> None:
    """Audit features that may be drawn and have not been, one family after the other; those that look ahead are frozen and disabled.

    stored() is called after each family, so that what has been audited is kept if a later family fails.
    """
    new = [f for f in registry.features if f not in weights.features_audit and weights.weight("feature", f) > 0]
    for names in registry.families("features", new):
        for r in audit(bars, registry, names, twice=True).collect():
            found = r.asDict()
            name = found.pop("feature")
            weights.features_audit[name] = found | {"checked_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            if r["flag_prefix"] or r["flag_leak"]:
                weights.toggle("feature", name, False)
        stored()


# ---- selections ------------------------------------------------------------------------------------------------------


@dataclass
class Facts:
    """What a selection must know of a target: rows that have one, ones among them, and its kind."""

    n: int
    ones: int
    binary: bool
    task: str


def facts(values: DataFrame, target: str) -> Facts:
    """Fractions, or more than ten values, make a target one for regression."""
    y = finite(target)
    few = values.select(y.alias("y")).where("y is not null").distinct().limit(11).count() <= 10
    r = values.select(y.alias("y")).agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("b"), F.bool_and(F.col("y") == F.floor("y")).alias("whole")).first()
    binary = bool(r["b"]) if r["n"] else False
    return Facts(r["n"], int(r["s"]) if binary else 0, binary, "clf" if binary or (r["whole"] and few) else "reg")


def allowed(names, target: str) -> list[str]:
    """Features but predictions of the target itself; DISABLE_TGT_FEAT_LEAK lifts that."""
    off = os.environ.get("DISABLE_TGT_FEAT_LEAK", "").lower() in ("1", "true", "yes")
    return [f for f in names if off or not f.startswith(f"pred_{target}")]


def build_selection(registry: Registry, weights: WeightStore, facts_of, seed: int | str, nfeat_min: int = 8, nfeat_max: int = 20, model: str | None = None, eval_cfg: str = "default") -> dict:
    """target, features, model, eval_cfg drawn by weight. facts_of: target name -> Facts. Bars are looked at only through it."""
    targets = {t: w for t in registry.targets if (w := weights.weight("target", t)) > 0}
    if not targets:
        raise RuntimeError("no target to select from")
    target = draw(f"{seed}:target", targets)[0]
    known = facts_of(target)
    features = {f: w for f in allowed(registry.features, target) if (w := weights.weight("feature", f)) > 0}
    if not features:
        raise RuntimeError("no feature to select from")
    # an eighth of the rows, and of the ones among them, bounds the number of features
    most = min([nfeat_max, len(features), *([max(1, known.n // 8)] if known.n else []), *([max(1, known.ones // 8)] if known.binary and known.ones else [])])
    ks = {f"k_{k}": weights.k_weights.get(f"k_{k}", 1.0) for k in range(min(nfeat_min, most), most + 1)}
    k = int(draw(f"{seed}:k", ks)[0][2:])
    for f in features:
        s = weights.features_stats.get(f, {})
        if s.get("n", 0) >= LEAST_USES and s.get("mean", 1.0) < POOR_MEAN:
            features[f] *= POOR_SHARE
    chosen = sorted(draw(f"{seed}:feature", features, k))
    if model is None:
        on = [m for m in registry.models if m not in weights.disabled_models]
        on = [m for m in on if registry.models[m] == known.task] or on
        if not on:  # all are off: the usual one, or whatever is registered
            if not registry.models:
                raise RuntimeError("no model to select from")
            on = [DEFAULT_MODEL if DEFAULT_MODEL in registry.models else next(iter(registry.models))]
        base = {m: weights.weight("model", m) for m in on}
        if sum(base.values()) <= 0:
            base = {m: PREFERRED.get(m, 1.0) for m in on}
        means = weights.model_target_stats.get(target, {})
        model = draw(f"{seed}:model", {m: w * (0.5 + max(0.0, min(1.0, means.get(m, {}).get("mean", 0.0)))) for m, w in base.items()})[0]
    return {"target": target, "features": chosen, "model": model, "eval_cfg": eval_cfg}


def select_components(registry: Registry, seed: int | str) -> dict:
    """A target, one to three features, a model and an evaluation setting, all alike."""
    one = lambda kind, names: draw(f"{seed}:{kind}", dict.fromkeys(names, 1.0))[0]
    k = int(one("k", [str(k) for k in range(1, min(3, len(registry.features)) + 1)]))
    features = draw(f"{seed}:feature", dict.fromkeys(registry.features, 1.0), k)
    return {"target": one("target", registry.targets), "features": sorted(features), "model": one("model", registry.models), "eval_cfg": one("eval", registry.eval_cfgs) if registry.eval_cfgs else "default"}


# ---- runs ------------------------------------------------------------------------------------------------------------


def key_of(dataset: str, split_id: str, selection: dict, seed: int) -> str:
    """The same digest as history.run_key gives as a column."""
    made = {"df": {"name": dataset, "split_id": split_id}, "eval": selection["eval_cfg"], "features": sorted(selection["features"]), "model": selection["model"], "seed": seed, "target": selection["target"]}
    return hashlib.sha256(json.dumps(made, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass
class Lab:
    """A dataset store, a run log, a registry, and a weight document's path."""

    spark: SparkSession
    store: Store
    runs: RunLog
    registry: Registry
    weights_path: str

    def _column(self, dataset: str, kind: str, name: str) -> DataFrame:
        """The stored column. Where it isn't there, all columns of its family are computed at once and stored."""
        if not self.store.column_exists(dataset, kind, name):
            known = self.registry.targets if kind == "target" else self.registry.features
            make = self.registry.get_target(name) if kind == "target" else self.registry.get_feature(name)
            family = [n for n, m in known.items() if m is make and (n == name or not self.store.column_exists(dataset, kind, n))]
            made = make(self.store.load(dataset))
            family = [n for n in family if n in made.columns] or [name]
            whole = written(made.select(*KEYS, *[F.col(f"`{n}`") for n in family]), "family")
            for n in family:
                self.store.save_column(dataset, kind, n, whole)
        return self.store.load_column(dataset, kind, name)

    def facts(self, dataset: str, target: str) -> Facts:
        return facts(self._column(dataset, "target", target), target)

    def run(self, dataset: str, split_id: str, selection: dict, seed: int = 0) -> str | None:
        """The id of a finished run, or None where the same one is on record. A failure is recorded and raised."""
        selection = {"eval_cfg": "default"} | selection
        selection["features"] = allowed(selection["features"], selection["target"])
        try:
            run_id = self.runs.create(key_of(dataset, split_id, selection, seed), selection)
        except ValueError:
            return None
        self.runs.start(run_id)
        failed: list[dict] = []
        try:
            x, y, used = self._column(dataset, "target", selection["target"]), selection["target"], []
            for f in selection["features"]:
                try:
                    x = x.join(self._column(dataset, "feature", f), list(KEYS))
                    used.append(f)
                except Exception as error:  # one feature that can't be made doesn't end the run
                    failed.append({"id": f, "error": str(error)[:500]})
            if not used:
                raise RuntimeError("no feature could be computed")
            close = S.affinity(x, used, y).join(D.dependence(x, used, y).drop("n_eff"), "feature", "left").collect()
            affinity = {r["feature"]: {"pearson": r["pearson"], "spearman": r["spearman"], "mi": r["mi_knn"], "dcor": r["dcor"], "n_eff": r["n_eff"]} for r in close}
            metrics = self.metrics(x, used, selection)
        except Exception as error:
            self.runs.fail(run_id, str(error)[:2000])
            raise
        self.runs.succeed(run_id, metrics, {"affinity": affinity, "failed_features": failed})
        return run_id

    def metrics(self, x: DataFrame, used: list[str], selection: dict) -> dict:
        """The metrics of a run by its evaluation setting. rf and hgb take medians over five expanding folds where the setting is one split in time."""
        cfg, model = self.registry.eval_cfgs.get(selection["eval_cfg"], {}), selection["model"]
        split = cfg.get("split", "time")
        split = "expanding" if split == "time" and model in E.FOLDED else split
        done = E.evaluated(x, used, selection["target"], model, split, cfg.get("gap", 0), cfg.get("folds", 5), cfg.get("settings", {}).get(model))
        if done.preds is None:
            raise RuntimeError("no fold has two classes to train on")
        fitted = {"n_train": max(t["n_train"] for t in done.train), "fit_time_sec": sum(t["fit_seconds"] for t in done.train)}
        began = time.time()
        p = done.preds.select(F.lit("run").alias("run_id"), F.concat_ws(":", *KEYS).alias("row_id"), *[c for c in done.preds.columns if c not in KEYS]).persist()
        try:
            n = p.count()
            took, means = time.time() - began, [t["y_train_mean"] for t in done.train]
            if model in E.REGRESSIONS:
                known = p.join(F.broadcast(done.train_frame(self.spark)), "fold")  # a handful of folds
                found = (S.regression(known) if split == "time" else S.regression_over_folds(known)).first().asDict()
                found["skill"] = found.pop("skill_rmse")
            elif split != "time":
                found = S.fold_summary(S.over_folds(p, many=done.classes > 2)).first().asDict() | {"pos_rate_train": statistics.median(means) if done.classes == 2 else None}
            elif done.classes > 2:
                found = S.multiclass(p).drop("n").first().asDict()
            else:
                found = S.classification(p).first().asDict() | {"pos_rate_train": means[0]}
                found["pos_rate_test"] = found.pop("n_pos") / max(1, found.pop("n"))
            found.pop("run_id")
            return found | fitted | {"n_test": n, "predict_time_sec": took}
        finally:
            p.unpersist()

    def random_run(self, dataset: str, split_id: str, seed: int = 0) -> str | None:
        """One run of components drawn without weights."""
        return self.run(dataset, split_id, select_components(self.registry, seed), seed)

    def learn(self, run_id: str, weights: WeightStore, alpha: float = 0.2) -> None:
        """Fold one successful run into the weights."""
        rows = H.shredded(self.runs.runs().where(F.col("run_id") == run_id))
        row = rows.select(H.run_score().alias("score"), "affinity", "failed_features").first()
        if row is None:
            return
        each = {r["name"]: r["score"] for r in H.run_events(rows).where("kind = 'feature' and score is not null").collect()}
        weights.update(self.runs.selection(run_id), row["score"], each, [f["id"] for f in row["failed_features"] or []], alpha)

    def loop(self, dataset: str, split_id: str, n_runs: int = 10, seed: int = 0, alpha: float = 0.2, **how) -> list[str | None]:
        """n_runs runs. What others change in the weight document between runs holds from the next one on."""
        out: list[str | None] = []
        for k in range(n_runs):
            weights = WeightStore.load(self.spark, self.weights_path)
            audit_candidates(self.store.load(dataset), self.registry, weights, lambda w=weights: w.save(self.spark, self.weights_path))
            selection = build_selection(self.registry, weights, lambda t: self.facts(dataset, t), seed + k, **how)
            out.append(self.run(dataset, split_id, selection, seed + k))
            if out[-1] is not None:
                self.learn(out[-1], weights, alpha)
            weights.save(self.spark, self.weights_path)
        return out

    # ---- what has been run

    def frame(self, run_id: str, dataset: str) -> tuple[DataFrame, list[str], str, str]:
        """The columns of a run's selection on a dataset, its features, target and model."""
        s = self.runs.selection(run_id)
        x, features = self._column(dataset, "target", s["target"]), allowed(s["features"], s["target"])
        for f in features:
            x = x.join(self._column(dataset, "feature", f), list(KEYS))
        return x, features, s["target"], s["model"]

    def validate(self, run_ids: list[str], dataset: str, gaps: tuple[int, ...] = V.GAPS) -> DataFrame:
        """run_id, gap and metrics of runs on record, refitted on a dataset (their own or another) with each gap, and with permuted labels."""
        settings = self.registry.eval_cfgs.get("default", {}).get("settings")
        return V.over_gaps({r: self.frame(r, dataset) for r in run_ids}, gaps, settings=settings)

    def best_runs(self, n: int = 10) -> list[str]:
        """The ids of the n successful runs with the highest scores."""
        rows = H.shredded(self.runs.runs()).select("run_id", H.run_score().alias("score")).where("score is not null")
        return [r["run_id"] for r in rows.orderBy(F.desc("score"), "run_id").limit(n).collect()]

    def walk_forward(self, run_id: str, dataset: str, k: int = 5, gap: int = 12) -> DataFrame:
        """fold, n_test, pos_rate, auc, ap of a run's selection over walk-forward folds."""
        x, features, target, model = self.frame(run_id, dataset)
        done = E.evaluated(x, features, target, model, "walk", gap, k, self.registry.eval_cfgs.get("default", {}).get("settings", {}).get(model))
        if done.preds is None:
            raise ValueError("no fold has two classes to train on")
        p = done.preds.withColumns({"run_id": F.lit(run_id), "row_id": F.concat_ws(":", *KEYS)}).drop(*KEYS)
        return S.over_folds(p, many=done.classes > 2)

    def prediction_feature(self, run_id: str, dataset: str, k: int = 5, gap: int = 12) -> str:
        """The name of the out-of-fold predictions of a run's selection; made and stored as a feature of the dataset where it isn't yet, and registered."""
        s = self.runs.selection(run_id)
        name = f"pred_{s['target']}__{s['model']}__oof"
        if not self.store.column_exists(dataset, "feature", name):
            x, features, target, model = self.frame(run_id, dataset)
            settings = self.registry.eval_cfgs.get("default", {}).get("settings", {}).get(model)
            self.store.save_column(dataset, "feature", name, E.out_of_fold(x, features, target, model, k, gap, settings))
        self.register_predictions(dataset)
        return name

    def register_predictions(self, dataset: str) -> list[str]:
        """Register each stored prediction of the dataset as a feature that is loaded; names that are registered stay as they are."""
        new = [n for n in self.store.predictions(dataset) if n not in self.registry.features]
        for n in new:
            self.registry.register_feature(n)(lambda bars, n=n: self.store.load_column(dataset, "feature", n))
        return new
