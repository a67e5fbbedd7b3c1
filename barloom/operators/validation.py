"""Validation of runs and columns: grades, folds, gaps, coverage, listings, and what plots need."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import experiments as E
from barloom.operators import scores as S
from barloom.operators.exprs import KEYS, clip, finite, union_all
from barloom.operators.quantiles import quantiles

LABELS = ("very poor", "poor", "acceptable", "good", "excellent")
GAPS = (0, 6, 12, 24)


def unit(x: Column) -> Column:
    return F.coalesce(clip(x, 0.0, 1.0), F.lit(0.0))


def permutation_grade(auc: Column, ap: Column, base: Column) -> Column:
    """0 to 5: how near the scores of permuted labels are to chance."""
    room = F.greatest(F.lit(0.05), 1 - F.least(F.lit(0.99), base))
    return 5 * (0.6 * unit(1 - F.abs(auc - 0.5) / 0.1) + 0.4 * unit(1 - F.abs(ap - base) / room))


def regression_grade(skill: Column, r2: Column) -> Column:
    return 5 * unit(F.coalesce(skill, r2))


def label(grade: Column) -> Column:
    """The name of a grade: one for each whole point."""
    return F.element_at(F.array(*map(F.lit, LABELS)), (F.least(F.floor(grade), F.lit(4)) + 1).cast("int"))


def permutation_test(preds: DataFrame, seed: int = 42) -> DataFrame:
    """Per run AUC and AP with labels dealt anew, the positive rate, and the grade."""
    got = S.classification(E.permuted(preds, seed)).select("run_id", F.col("auc").alias("auc_perm"), F.col("ap").alias("ap_perm"), F.try_divide("n_pos", "n").alias("baseline_pos_rate"))
    grade = permutation_grade(F.col("auc_perm"), F.col("ap_perm"), F.col("baseline_pos_rate"))
    return got.withColumns({"grade": grade, "label": label(grade)})


def by_fold(preds: DataFrame, least: int = 50) -> DataFrame:
    """run_id, fold, n_test, pos_rate, auc, ap of (run_id, fold, row_id, y, p); folds too small or of one class are left out."""
    one = preds.withColumn("_rf", F.to_json(F.struct("run_id", "fold")))
    got = S.classification(one, "_rf").where(F.col("auc").isNotNull() & (F.col("n") >= least))
    key = F.from_json("_rf", "run_id string, fold int")
    return got.select(key["run_id"].alias("run_id"), key["fold"].alias("fold"), F.col("n").alias("n_test"), F.try_divide("n_pos", "n").alias("pos_rate"), "auc", "ap")


def walk_forward(folds: DataFrame) -> DataFrame:
    """Per run the median and quartiles of its folds' AUC and AP, and how many there are."""
    q = lambda c, p: F.percentile(c, p)
    return folds.groupBy("run_id").agg(F.count("*").alias("folds"), *[q(c, p).alias(f"{c}_{n}") for c in ("auc", "ap") for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))])


def over_gaps(frames: dict[str, tuple[DataFrame, list[str], str, str]], gaps: tuple[int, ...] = GAPS, at_once: int = 4, settings: dict | None = None) -> DataFrame:
    """The metrics of each run (id -> frame, features, target, model) refitted with each gap between training and test, and with permuted labels.

    Runs and gaps are a handful: one fit each, at_once of them at the same time. All predictions then go through one plan. A run whose
    training rows have one class has no rows. settings: parameters of learners, by model.
    """
    jobs = [(run_id, gap) for run_id in frames for gap in gaps]
    if not jobs:
        raise ValueError("no runs")
    spark = next(iter(frames.values()))[0].sparkSession

    def fit(job: tuple[str, int]) -> DataFrame | None:
        frame, features, target, model = frames[job[0]]
        p = E.evaluated(frame, features, target, model, "time", job[1], settings=(settings or {}).get(model)).preds
        return None if p is None else p.select(F.lit(f"{job[0]}|{job[1]}").alias("run_id"), F.concat_ws(":", *KEYS).alias("row_id"), "y", "p")

    with ThreadPoolExecutor(at_once) as pool:
        made = [p for p in pool.map(inheritable_thread_target(spark)(fit), jobs) if p is not None]
    preds = union_all(made) if made else spark.createDataFrame([], "run_id string, row_id string, y double, p double")
    out = S.classification(preds).join(permutation_test(preds).select("run_id", "auc_perm", "ap_perm", "grade"), "run_id")
    return out.withColumns({"gap": F.substring_index("run_id", "|", -1).cast("int"), "run_id": F.substring_index("run_id", "|", 1)})


# ---- columns ---------------------------------------------------------------------------------------------------------


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, non_null_ratio, mean, std, min, q25, q50, q75, max."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in columns])).alias("r")).select("r.*")
    flat = long.groupBy("column").agg(F.count("x").alias("count"), (F.count("x") / F.count("*")).alias("non_null_ratio"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    found = quantiles(long, ["column"], {"q25": ("x", 0.25), "q50": ("x", 0.5), "q75": ("x", 0.75)})
    return flat.join(found, "column", "left").select("column", "count", "non_null_ratio", "mean", "std", "min", "q25", "q50", "q75", "max")


def coverage(df: DataFrame, targets: list[str]) -> DataFrame:
    """target, coverage (share of rows that have one), positive_rate (missing ones count as 0)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), finite(t).alias("y")) for t in targets])).alias("r")).select("r.*")
    return long.groupBy("target").agg(F.avg(F.col("y").isNotNull().cast("int")).alias("coverage"), F.avg(F.coalesce("y", F.lit(0.0))).alias("positive_rate"))


def overlap(oof: DataFrame, target: DataFrame, p: str, y: str) -> DataFrame:
    """Rows that have both an out-of-fold prediction and a target."""
    return oof.join(target.select(*KEYS, y), list(KEYS)).where(F.col(p).isNotNull() & F.col(y).isNotNull())


def aligned(bars: DataFrame, preds: DataFrame) -> DataFrame:
    """Every bar, with its prediction where there is one."""
    return bars.join(preds, list(KEYS), "left")


def normalized_like(df: DataFrame, base: str, ref: str, name: str, by: str = "series_id") -> DataFrame:
    """Adds base scaled to the range of ref (not to its level); half that range where base is constant."""
    w = Window.partitionBy(by)
    low, high = F.min(base).over(w), F.max(base).over(w)
    room = F.max(ref).over(w) - F.min(ref).over(w)
    return df.withColumn(name, F.when(high == low, room / 2).otherwise(F.try_divide(F.col(base) - low, F.greatest(F.lit(1e-12), high - low)) * room))


def color_bounds(values: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """vmin and vmax of all the columns' values together; 0 and 1 where they don't differ."""
    one = values.select(F.explode(F.array(*[finite(c) for c in columns])).alias("x")).where("x is not null")
    got = quantiles(one, [], {"a": ("x", lo), "b": ("x", hi)}).select("a", "b")
    got = got.agg(F.max("a").alias("a"), F.max("b").alias("b"))  # one row even where there is no value
    flat = F.coalesce(F.col("a") == F.col("b"), F.lit(True))
    return got.select(F.when(flat, 0.0).otherwise(F.col("a")).alias("vmin"), F.when(flat, 1.0).otherwise(F.col("b")).alias("vmax"))


def in_focus(p: Column, center: float, width: float) -> Column:
    return F.coalesce(F.abs(p - center) <= width, F.lit(False))


# ---- listings and keys -----------------------------------------------------------------------------------------------


def audit_listing(audits: DataFrame) -> DataFrame:
    """Stored audits with a status: error, suspicious, ok, in that order of precedence."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(F.col("error").isNotNull(), "error").when(on("flag_prefix") | on("flag_leak"), "suspicious").otherwise("ok")
    return audits.select("feature", "nan_rate", "prefix_mismatch_rate", "leak_score", status.alias("status"))


def by_checkpoint(bars: DataFrame, make, columns: list[str], checkpoints=(0.5, 0.7, 0.9), guard: int = 50) -> DataFrame:
    """feature and mismatch_<checkpoint> for each: the audit's detail."""
    out = None
    for c in checkpoints:
        one = S.prefix_stability(bars, make, columns, (c,), guard).select("feature", F.col("mismatch_rate").alias(f"mismatch_{c:.2f}".replace(".", "_")))
        out = one if out is None else out.join(one, "feature", "full")
    return out


def entity_id(name: Column, params: Column, code: Column, extra: Column) -> Column:
    """SHA-256 of what makes a computed column what it is; params is a struct or map, keys in order."""
    return F.sha2(F.to_json(F.struct(code.alias("code_hash"), extra.alias("extra"), name.alias("name"), params.alias("params"))), 256)


def unseen(candidates: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose key isn't known: exact, and Spark filters the larger side by the smaller's Bloom filter where that pays."""
    return candidates.join(known.select(key), key, "left_anti")


def fraction(x: Column) -> Column:
    """A percentage, number or text with or without its sign, as a fraction; null where it is none."""
    return F.try_divide(F.regexp_replace(x.cast("string"), r"[%\s]", "").try_cast("double"), F.lit(100.0))
