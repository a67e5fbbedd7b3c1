"""Splits, models and out-of-fold predictions."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import boosting, network
from barloom.operators.exprs import KEYS, finite, union_all

FRACTIONS = (0.8, 0.75, 0.7, 0.65, 0.6)
REGRESSIONS = ("hgb_regressor", "tf_mlp_regressor")


def matrix(df: DataFrame, features: list[str], target: str) -> tuple[DataFrame, list[str]]:
    """Rows with a target, infinities as null, and the features that aren't null throughout."""
    d = df.select(*KEYS, *[finite(c).alias(c) for c in features], finite(target).alias("y")).where("y is not null")
    n = d.agg(*[F.count(c).alias(c) for c in features]).first()
    used = [c for c in features if n[c]]
    return d.select(*KEYS, *used, "y"), used


def time_split(df: DataFrame, min_train: int = 50, min_test: int = 20) -> float:
    """The first of FRACTIONS that leaves both sides large enough and with two classes; else 0.8. One aggregate decides."""
    n = df.groupBy("series_id").agg(F.count("*").alias("_n"))
    d = df.withColumn("_pos", F.row_number().over(_order()) - 1).join(n, "series_id")
    parts = []
    for k, f in enumerate(FRACTIONS):
        train = F.col("_pos") < F.floor(F.col("_n") * f)
        parts += [F.count_if(train).alias(f"a{k}"), F.count_if(~train).alias(f"b{k}"), F.count_distinct(F.when(train, F.col("y"))).alias(f"c{k}"), F.count_distinct(F.when(~train, F.col("y"))).alias(f"d{k}")]
    got = d.agg(F.count("*").alias("n"), *parts).first()
    if got["n"] <= max(min_train + min_test, 10):
        return 0.8
    return next((f for k, f in enumerate(FRACTIONS) if got[f"a{k}"] >= min_train and got[f"b{k}"] >= min_test and got[f"c{k}"] > 1 and got[f"d{k}"] > 1), 0.8)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("series_id").orderBy("bar_idx")


def with_split(df: DataFrame, fraction: float, gap: int = 0) -> DataFrame:
    """Adds part: train before the cut, test from `gap` rows behind it; rows between have none."""
    n = df.groupBy("series_id").agg(F.count("*").alias("_n"))
    d = df.withColumn("_pos", F.row_number().over(_order()) - 1).join(n, "series_id")
    cut = F.floor(F.col("_n") * fraction)
    return d.withColumn("part", F.when(F.col("_pos") < cut, "train").when(F.col("_pos") >= cut + gap, "test")).drop("_pos", "_n")


def folds(df: DataFrame, k: int = 5, kind: str = "expanding", gap: int = 0, min_train: int = 100, min_test: int = 50) -> DataFrame:
    """series_id, fold, train_end, test_start, test_end (positions; ends exclusive) of time-ordered folds.

    expanding: k tests of n // (k + 1) rows at the end. walk: test i is [n i / k, n (i + 1) / k), training ends gap rows before;
    folds with too few rows are left out.
    """
    n = df.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    if kind == "expanding":
        size = F.floor(F.col("n") / (k + 1))
        start = F.col("n") - (k - F.col("fold")) * size
        return n.select("series_id", "fold", (start - gap).cast("long").alias("train_end"), start.cast("long").alias("test_start"), (start + size).cast("long").alias("test_end"))
    start, end = F.floor(F.col("n") * F.col("fold") / k), F.floor(F.col("n") * (F.col("fold") + 1) / k)
    d = n.select("series_id", "fold", F.greatest(start - gap, F.lit(0)).cast("long").alias("train_end"), start.cast("long").alias("test_start"), end.cast("long").alias("test_end"))
    return d.where((F.col("train_end") >= min_train) & (F.col("test_end") - F.col("test_start") >= min_test))


def labelled(df: DataFrame, model: str) -> tuple[DataFrame, int]:
    """Adds what a learner needs besides y, and the number of classes: label counts the distinct targets from 0 in ascending
    order, held marks a tenth of the rows, by which boosting knows when to stop."""
    if model.startswith("hgb_"):
        return df.withColumn("held", F.pmod(F.xxhash64(*KEYS), F.lit(10)) == 0), 2
    if model != "tf_mlp_multiclass":
        return df, 2
    values = sorted(r[0] for r in df.select("y").distinct().collect())
    return df.withColumn("label", (F.array_position(F.array(*map(F.lit, values)), F.col("y")) - 1).cast("double")), max(2, len(values))


def estimator(name: str, n_rows: int, features: list[str], classes: int = 2, settings: dict | None = None):
    """A pipeline for a model name: median imputation, then scaling and the learner.

    Boosting and tf_mlp_multiclass need the columns of labelled(), networks the keys. settings: parameters of the learner to replace, such as numTrees, epochs or rounds.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml import classification as C
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"_{c}" for c in features]
    common = dict(featuresCol="x", labelCol="y")
    learners: dict[str, Callable] = {
        "logistic_baseline": lambda: C.LogisticRegression(maxIter=1000, regParam=1.0 / max(1, n_rows), **common),
        "rf_baseline": lambda: C.RandomForestClassifier(numTrees=600, maxDepth=12, minInstancesPerNode=100, seed=42, **common),
        "hgb_baseline": lambda: boosting.Boosting(boosting.Spec()),
        "hgb_regressor": lambda: boosting.Boosting(boosting.Spec(kind="squared")),
        **{m: lambda m=m: network.Network(network.MODELS[m]) for m in ("tf_mlp_baseline", "tf_mlp_bn_wd", "tf_mlp_regressor")},
        "tf_mlp_multiclass": lambda: network.Network(replace(network.MODELS["tf_mlp_multiclass"], **({"kind": "softmax", "n_out": classes} if classes > 2 else {})), "label"),
    }
    if name not in learners:
        raise KeyError(name)
    learner = learners[name]()
    if hasattr(learner, "with_settings"):
        learner = learner.with_settings(settings or {})
    else:
        for key, value in (settings or {}).items():
            learner.set(learner.getParam(key), value)
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), learner])


def predict(model, df: DataFrame, classes: int = 2) -> DataFrame:
    """Keys, y and p: the second class's probability, or the predicted value. Of more than two classes p is an array of all by ascending target, and label the row's own place among them."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    p = F.col("p" if "p" in out.columns else "prediction")
    if "probability" in out.columns:
        p = vector_to_array(F.col("probability"))
        p = p if classes > 2 else p[1]
    more = [F.col("label").cast("int").alias("label")] if classes > 2 else []
    return out.select(*KEYS, "y", p.alias("p"), *more)


#: Models whose metrics are those of five expanding folds, unless the evaluation setting says otherwise.
FOLDED = ("rf_baseline", "hgb_baseline")


@dataclass
class Evaluation:
    """preds: fold, keys, y, p of all test rows. train: for each fold that was fitted n_train, y_train_mean and fit_seconds."""

    preds: DataFrame | None
    train: list[dict]
    classes: int = 2

    def train_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t["fold"], t["n_train"], t["y_train_mean"]) for t in self.train], "fold int, n_train long, y_train_mean double")


def fold_table(positions: DataFrame, split: str, gap: int = 0, k: int = 5) -> DataFrame:
    """The folds of a split by name: time (one, by time_split), expanding or walk."""
    if split != "time":
        return folds(positions, k, split, gap)
    n = positions.groupBy("series_id").agg(F.count("*").alias("n"))
    cut = F.floor(F.col("n") * time_split(positions)).cast("long")
    return n.select("series_id", F.lit(0).alias("fold"), cut.alias("train_end"), (cut + gap).alias("test_start"), F.col("n").cast("long").alias("test_end"))


def evaluated(df: DataFrame, features: list[str], target: str, model: str, split: str = "time", gap: int = 0, k: int = 5, settings: dict | None = None) -> Evaluation:
    """Each fold's test rows, predicted by a model of what lies before them.

    One aggregate says of all folds how many rows they train on, with what mean and which features they have. The fits then run at the
    same time, so that their many short jobs share the cluster, and all predictions are one frame. A fold whose training rows have
    one class is left out (of regressions: that has no training rows), and a feature that is null throughout its training rows.
    """
    d, used = matrix(df, features, target)
    d, classes = labelled(d, model)
    d = d.withColumn("pos", F.row_number().over(_order()) - 1).persist()
    try:
        both = d.join(F.broadcast(fold_table(d, split, gap, k)), "series_id")  # one row for each series and fold
        train, test = both.where("pos < train_end"), both.where("pos >= test_start and pos < test_end")
        facts = train.groupBy("fold").agg(F.count("*").alias("n_train"), F.avg("y").alias("y_train_mean"), F.min("y").alias("_lo"), F.max("y").alias("_hi"), *[F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(used)])
        least = (lambda r: True) if model in REGRESSIONS else (lambda r: r["_lo"] < r["_hi"])
        known = [r for r in sorted(facts.collect(), key=lambda r: r["fold"]) if least(r)]

        def fit(r) -> tuple[DataFrame, float]:
            own, began = [c for i, c in enumerate(used) if r[f"n_{i}"]], time.time()
            fitted = estimator(model, r["n_train"], own, classes, settings).fit(train.where(F.col("fold") == r["fold"]))
            return predict(fitted, test.where(F.col("fold") == r["fold"]), classes).withColumn("fold", F.lit(r["fold"])), time.time() - began

        with ThreadPoolExecutor(max(1, len(known))) as pool:
            made = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), known))
        said = [{"fold": r["fold"], "n_train": r["n_train"], "y_train_mean": r["y_train_mean"], "fit_seconds": t} for r, (_, t) in zip(known, made, strict=True)]
        return Evaluation(union_all([p for p, _ in made]) if made else None, said, classes)
    finally:
        d.unpersist()


def fit_and_score(df: DataFrame, features: list[str], target: str, model: str = "logistic_baseline", gap: int = 0) -> DataFrame:
    """Predictions on the test part of a model trained on the train part."""
    found = evaluated(df, features, target, model, "time", gap)
    if found.preds is None:
        raise ValueError("the rows to train on have one class")
    return found.preds.drop("fold")


def out_of_fold(df: DataFrame, features: list[str], target: str, model: str = "logistic_baseline", k: int = 5, gap: int = 12, settings: dict | None = None) -> DataFrame:
    """Keys and pred_<target>__<model>__oof: each row's prediction by the model of the fold that tests it; null outside."""
    found, name = evaluated(df, features, target, model, "walk", gap, k, settings), f"pred_{target}__{model}__oof"
    if found.preds is None:
        return df.select(*KEYS, F.lit(None).cast("array<double>" if found.classes > 2 else "double").alias(name))
    return df.select(*KEYS).join(found.preds.select(*KEYS, F.col("p").alias(name)), list(KEYS), "left")


def permuted(preds: DataFrame, seed: int = 42) -> DataFrame:
    """(run_id, row_id, y, p) with labels dealt anew within each run, in the order of a digest of seed and row: the same on every run."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id")
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")).cast("binary"))
    a = preds.withColumn("_i", F.row_number().over(w.orderBy("row_id"))).drop("y")
    b = preds.select("run_id", "y", F.row_number().over(w.orderBy(mixed, "row_id")).alias("_i"))
    return a.join(b, ["run_id", "_i"]).drop("_i")
