"""Scores of columns and predictions: affinity, audits, target health, classification and regression metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.exprs import KEYS, by_time, corr, div, finite


def value_bucket(x: Column) -> Column:
    """A whole number that never falls where x rises: its sign, exponent and first 12 bits of mantissa. Null for null."""
    size = F.abs(x.cast("double"))
    power = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
    bucket = (power + 1100) * 4096 + F.floor((size / F.pow(F.lit(2.0), power) - 1) * 4096)
    return F.when(x.isNotNull(), F.when(size < 1e-300, F.lit(0)).otherwise(F.signum(x.cast("double")) * bucket)).cast("long")


def running_totals(counted: DataFrame, by: list[str], x: str, totals: dict[str, str], down: bool = False) -> DataFrame:
    """Adds the totals (name -> column to add up) of all rows of a group up to and with x, in order of x; counted has one row for each by and x.

    Values are cut into buckets that keep their order. Windows run within a bucket, and once more over the buckets' sums, of which
    a group has some thousands, so no task holds all values of a group.
    """
    d = counted.withColumn("_b", value_bucket(F.col(x)))
    order = lambda c: F.desc(c) if down else F.asc(c)
    sums = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*by).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    inside = Window.partitionBy(*by, "_b").orderBy(order(x)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({n: F.sum(c).over(inside) for n, c in totals.items()})
    return d.join(sums, [*by, "_b"]).withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop("_b", *[f"_{n}" for n in totals])


def ranked(df: DataFrame, x: str, name: str, by: list[str]) -> DataFrame:
    """Adds average ranks of x within groups. Equal values are counted first, so a group of ties is one row of the ranking."""
    sizes = running_totals(df.groupBy(*by, x).agg(F.count("*").alias("_c")), by, x, {"_upto": "_c"})
    return df.join(sizes.select(*by, x, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name)), [*by, x])


def long_form(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(feature, x, y) rows: one for each row and column where both are finite."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("x")) for c in columns]))
    out = df.select(finite(y).alias("y"), pairs.alias("p")).select(F.col("p.feature").alias("feature"), F.col("p.x").alias("x"), "y")
    return out.where("x is not null and y is not null")


def affinity(df: DataFrame, columns: list[str], y: str, bins: int = 10) -> DataFrame:
    """feature, pearson, spearman, mi_binned, n_eff of each column with y; null below ten rows or without spread."""
    pairs = long_form(df, columns, y)
    r = ranked(ranked(pairs, "x", "rx", ["feature"]), "y", "ry", ["feature"])
    g = r.groupBy("feature").agg(F.count("*").alias("n_eff"), corr("x", "y").alias("p"), corr("rx", "ry").alias("s"), (F.min("x") < F.max("x")).alias("vx"), (F.min("y") < F.max("y")).alias("vy"))
    ok = (F.col("n_eff") >= 10) & F.col("vx") & F.col("vy")
    cell = r.join(g.select("feature", "n_eff"), "feature").select("feature", "n_eff", *[F.least(F.lit(bins - 1), F.floor((F.col(k) - 1) * bins / F.col("n_eff"))).alias(b) for k, b in (("rx", "bx"), ("ry", "by"))])
    cell = cell.groupBy("feature", "n_eff", "bx", "by").agg(F.count("*").alias("c"))
    cx = F.sum("c").over(Window.partitionBy("feature", "bx"))
    cy = F.sum("c").over(Window.partitionBy("feature", "by"))
    mi = cell.withColumns({"cx": cx, "cy": cy}).groupBy("feature").agg(F.sum(F.col("c") / F.col("n_eff") * F.ln(F.col("c") * F.col("n_eff") / (F.col("cx") * F.col("cy")))).alias("mi_binned"))
    return g.join(mi, "feature").select("feature", F.when(ok, F.col("p")).alias("pearson"), F.when(ok, F.col("s")).alias("spearman"), F.when(F.col("n_eff") >= 10, F.col("mi_binned")).alias("mi_binned"), "n_eff")


def affinity_score(pearson: Column, spearman: Column, mi: Column, dcor: Column, n_eff: Column) -> Column:
    z = lambda c: F.coalesce(F.when(~F.isnan(c.cast("double")), c), F.lit(0.0))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    base = 0.5 * F.greatest(F.abs(z(pearson)), F.abs(z(spearman))) + 0.25 * unit(z(mi) / 0.2) + 0.25 * unit(z(dcor))
    return unit(base * F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(n_eff.cast("double")), n_eff), F.lit(200.0)) / 200)))


def leak_scores(df: DataFrame, columns: list[str], price: str = "close") -> DataFrame:
    """feature, leak_score: rank correlation with the next return less that with the last one; null below fifty rows."""
    r = div(price, F.lag(price).over(by_time())) - 1
    d = df.withColumn("_r", r).withColumns({"_next": F.lead("_r").over(by_time()), "_past": F.lag("_r").over(by_time())})
    both = [affinity(d, columns, y).where("n_eff >= 50").select("feature", F.col("spearman").alias(y)) for y in ("_next", "_past")]
    return both[0].join(both[1], "feature").select("feature", (F.col("_next") - F.col("_past")).alias("leak_score"), (F.abs("_next") - F.abs("_past")).alias("leak_score_abs"))


def prefix_stability(bars: DataFrame, make, columns: list[str], checkpoints=(0.6, 0.8, 0.9), guard: int = 50, twice: bool = False) -> DataFrame:
    """feature, compared, changed, mismatch_rate: how often a feature of a prefix of the bars differs from that of all bars.

    make: bars -> feature frame. For each checkpoint the first K - guard rows of a prefix of K rows are compared. A feature that looks ahead to the
    end of a period, as of a day, goes unseen where the prefix ends with the period or up to guard rows after. With twice each prefix is also
    cut guard + 1 rows shorter; for periods of more than 2 guard + 1 rows, one of both cuts ends within a period and further from its start.
    """
    full = make(bars).select(*KEYS, *[finite(c).alias(c) for c in columns])
    n = bars.groupBy("series_id").agg(F.count("*").alias("_n"))
    parts = None
    for frac, less in [(frac, less) for frac in checkpoints for less in ((0, guard + 1) if twice else (0,))]:
        size = F.floor(F.col("_n") * frac) - less
        cut = bars.join(n, "series_id").withColumn("_k", size).where(f"bar_idx < _k and _k > {max(5, guard)}")
        head = make(cut.drop("_n", "_k")).select(*KEYS, *[finite(c).alias(f"_{c}") for c in columns])
        both = full.join(head, list(KEYS)).join(n, "series_id").where(F.col("bar_idx") < size - guard)
        rows = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("a"), F.col(f"_{c}").alias("b")) for c in columns])).alias("r")).select("r.*")
        parts = rows if parts is None else parts.unionByName(rows)
    differ = F.coalesce(F.abs(F.col("a") - F.col("b")) > 1e-9, F.col("a").isNull() != F.col("b").isNull())
    g = parts.groupBy("feature").agg(F.count("*").alias("compared"), F.count_if(differ).alias("changed"))
    return g.withColumn("mismatch_rate", F.col("changed") / F.col("compared"))


def target_health(df: DataFrame, y: str, by: str = "series_id") -> DataFrame:
    """Per series: nan and modal share, outlier share, positive share, entropy, run lengths, density, spread, first lag. The rest of Q11 is in target_scores."""
    d = df.select(by, "bar_idx", finite(y).alias("y"))
    modal = d.groupBy(by, "y").agg(F.count("*").alias("c")).groupBy(by).agg((F.max("c") / F.sum("c")).alias("const_rate"))
    from barloom.operators.quantiles import quantiles  # which ranks by this module's buckets

    q = d.select(by).distinct().join(quantiles(d, [by], {"q1": ("y", 0.25), "q3": ("y", 0.75), "q2": ("y", 0.5)}), by, "left")
    w = Window.partitionBy(by).orderBy("bar_idx")
    known = d.where("y is not null").withColumns({"_lag": F.lag("y").over(w), "_pos": F.row_number().over(w)})
    acf = known.groupBy(by).agg(corr("y", "_lag").alias("acf_lag1"))
    starts = (F.col("y") == 1) & (F.coalesce(F.col("_lag"), F.lit(0.0)) != 1)
    runs = known.groupBy(by).agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(starts).alias("runs"), F.min(F.when(starts, F.col("_pos"))).alias("s0"), F.max(F.when(starts, F.col("_pos"))).alias("s1"), F.count("*").alias("n"))
    density = F.when(F.col("runs") == 0, 0.0).when(F.col("runs") == 1, 1 / F.col("n")).otherwise((F.col("runs") - 1) / (F.col("s1") - F.col("s0")))
    runs = runs.select(by, F.coalesce(F.try_divide("ones", "runs"), F.lit(0.0)).alias("avg_event_len"), density.alias("label_density"))
    spread = F.col("q3") - F.col("q1")
    odd = (F.col("y") < F.col("q1") - 5 * spread) | (F.col("y") > F.col("q3") + 5 * spread)
    p = F.avg("y")
    stats = d.join(q, by).groupBy(by).agg(
        F.avg(F.col("y").isNull().cast("int")).alias("nan_rate"), F.coalesce(F.avg(F.when(spread > 0, odd.cast("int")).otherwise(F.when(F.col("y").isNotNull(), 0))), F.lit(0.0)).alias("outlier_rate"), p.alias("pos_rate"),
        F.try_divide(F.max("y") - F.min("y"), F.abs(F.max("q2")) + 1e-9).alias("range_rel"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("is_binary"),
    )
    h = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    stats = stats.withColumn("entropy_bits", h(F.col("pos_rate")) + h(1 - F.col("pos_rate")))
    return stats.join(modal, by).join(acf, by).join(runs, by)


def target_scores(df: DataFrame, y: str, horizon: int = 1, price: str = "close", by: str = "series_id") -> DataFrame:
    """All scores of a target per series, to its health from 0 to 1. Those of classes are null for other targets, and the reverse."""
    w = Window.partitionBy(by).orderBy("bar_idx")
    real = lambda c: F.when(~F.isnan(c), c)
    back = lambda k: div(F.lag(price, 1).over(w), F.lag(price, 1 + k).over(w)) - 1
    rets = {"ret_1": back(1), "ret_3": back(3), "ret_12": back(12), "next": div(F.lead(price).over(w), price) - 1}
    d = df.select(by, "bar_idx", finite(y).alias("y"), finite(price).alias(price)).withColumns(rets)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in rets])).alias("p")
    long = d.select(by, "y", pairs).select(by, "p.kind", "p.x", "y").where("x is not null and y is not null")
    r = ranked(ranked(long, "x", "rx", [by, "kind"]), "y", "ry", [by, "kind"])
    g = r.groupBy(by, "kind").agg(F.count("*").alias("n"), F.abs(real(corr("rx", "ry"))).alias("ic")).where("n >= 50")
    ics = g.groupBy(by).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("ic"))).alias("_next" if k == "next" else f"ic_{k}") for k in rets], F.percentile(F.when(F.col("kind") != "next", F.col("ic")), 0.5).alias("ic_median")
    )
    known = d.where("y is not null").withColumns({"_1": F.lag("y").over(w), "_h": F.lag("y", max(1, horizon)).over(w), "_pos": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(by))})
    modal = known.groupBy(by, "y").agg(F.count("*").alias("c")).groupBy(by).agg((F.max("c") / F.sum("c")).alias("const_rate"))
    first = F.col("_pos") <= F.floor(F.col("_n") / 2)
    ks = _ks(known.where("_n >= 200").groupBy(by, "y").agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b")), by, "y", "a", "b").withColumnRenamed("ks", "stability_ks")
    five = lambda c: F.when(F.count("*") >= 5, c)
    shape = known.groupBy(by).agg(
        F.bool_and(F.col("y").isin(0.0, 1.0)).alias("_bin"), five((F.max("y") - F.min("y")) / (F.avg(F.abs("y")) + 1e-12)).alias("range_rel"), five(real(F.skewness("y"))).alias("skew"), five(real(F.kurtosis("y"))).alias("kurtosis"),
        real(corr("y", "_1")).alias("acf_lag1"), real(corr("y", "_h")).alias("acf_lagH"),
    )
    basic = target_health(df, y, by).select(by, F.col("outlier_rate").alias("outlier_rate_IQR"), "pos_rate", "entropy_bits", "avg_event_len", "label_density")
    out = d.groupBy(by).agg(F.avg(F.col("y").isNull().cast("int")).alias("nan_rate"))
    for part in (modal, basic, ks, shape, ics):
        out = out.join(part, by, "left")
    binary = F.coalesce(F.col("_bin"), F.lit(True))
    out = out.withColumns({
        "task_type": F.when(binary, "clf").otherwise("reg"), "const_rate": F.coalesce("const_rate", F.lit(1.0)),
        **{k: F.when(binary, F.coalesce(k, F.lit(0.0))) for k in ("pos_rate", "entropy_bits", "avg_event_len", "label_density")},
        **{k: F.when(~binary, F.col(k)) for k in ("range_rel", "skew", "kurtosis", "acf_lag1", "acf_lagH")},
    })
    p = F.col("pos_rate")
    ratio = F.when(p.isin(0.0, 1.0), float("inf")).otherwise(F.greatest(p, 1 - p) / F.greatest(F.lit(1e-12), F.least(p, 1 - p)))
    leak = F.col("_next") - F.col("ic_ret_1")
    out = out.withColumns({"class_ratio": F.when(binary, ratio), "leakage_proxy_score": leak, "leakage_flag": F.coalesce(leak > 0.2, F.lit(False))})
    z = lambda c: F.coalesce(c, F.lit(0.0))
    least = lambda a, c: F.least(F.lit(a), z(c))
    health = 1 - 0.7 * F.col("nan_rate") - 0.5 * F.greatest(F.lit(0.0), F.col("const_rate") - 0.95) - 0.3 * least(1.0, 2 * F.col("outlier_rate_IQR")) - 0.3 * least(1.0, F.col("stability_ks"))
    classes = 0.8 * F.abs(p - 0.5) + F.when(p.isin(0.0, 1.0), 0.3).otherwise(0.0)
    values = F.when(F.col("range_rel") < 0.1, 0.2).otherwise(0.0) + F.when(F.abs("acf_lag1") < 0.02, 0.1).otherwise(0.0)
    health = health - F.when(F.col("task_type") == "clf", classes).otherwise(values) + 0.2 * least(0.5, F.col("ic_median")) - F.when(F.col("leakage_flag"), 0.4).otherwise(0.0)
    return out.withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), health))).drop("_bin", "_next")


def ks_halves(df: DataFrame, y: str, by: str = "series_id") -> DataFrame:
    """by, stability_ks: the two-sample Kolmogorov-Smirnov distance between the first and second half in time."""
    d = df.select(by, "bar_idx", finite(y).alias("y")).where("y is not null")
    half = F.ntile(2).over(Window.partitionBy(by).orderBy("bar_idx"))
    c = d.withColumn("h", half).groupBy(by, "y").agg(F.count_if(F.col("h") == 1).alias("a"), F.count_if(F.col("h") == 2).alias("b"))
    return _ks(c, by, "y", "a", "b").select(by, F.col("ks").alias("stability_ks"))


def _ks(counted: DataFrame, by: str, x: str, a: str, b: str) -> DataFrame:
    whole = counted.groupBy(by).agg(F.sum(a).alias("all_a"), F.sum(b).alias("all_b"))
    d = running_totals(counted.where(F.col(x).isNotNull()), [by], x, {"seen_a": a, "seen_b": b}).join(whole, by)
    return d.groupBy(by).agg(F.max(F.abs(F.try_divide("seen_a", "all_a") - F.try_divide("seen_b", "all_b"))).alias("ks"))


def classification(preds: DataFrame, by: str = "run_id", tie: str = "row_id") -> DataFrame:
    """AUC and its interval, AP and lift, KS, Brier, accuracy, precision at 1, 5, 10 % per run of (run_id, row_id, y, p).

    Rows are counted for each distinct score first; curves are windows over those counts.
    """
    d = preds.select(by, tie, F.col("y").cast("int").alias("y"), finite("p").alias("p")).where("y is not null and p is not null")
    c = d.groupBy(by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    c = c.withColumn("neg", F.col("n") - F.col("pos"))
    whole = c.groupBy(by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    c = running_totals(c, [by], "p", {"tp": "pos", "fp": "neg"}, down=True).join(whole, by)
    curve = c.groupBy(by).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap_sum"),
        F.max(F.abs(F.try_divide("tp", "all_pos") - F.try_divide("fp", "all_neg"))).alias("ks"),
    )
    pc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    flat = d.groupBy(by).agg(F.avg((pc - F.col("y")) * (pc - F.col("y"))).alias("brier"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    # a row's place: the rows of higher scores, and its own among equal ones
    place = F.col("tp") + F.col("fp") - F.col("n") + F.row_number().over(Window.partitionBy(by, "p").orderBy(tie))
    rank = d.join(c.select(by, "p", "tp", "fp", "n", (F.col("all_pos") + F.col("all_neg")).alias("_n")), [by, "p"]).withColumn("_r", place)
    top = lambda f: F.avg(F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * f)), F.col("y")))
    at = rank.groupBy(by).agg(*[top(f).alias(f"precision_at_{k}pct") for k, f in ((1, 0.01), (5, 0.05), (10, 0.1))])
    out = curve.join(flat, by).join(at, by).withColumn("auc", F.try_divide("area", F.col("n_pos") * F.col("n_neg"))).withColumn("ap", F.try_divide("ap_sum", "n_pos"))
    a, m, n = F.col("auc"), F.col("n_pos"), F.col("n_neg")
    se = F.sqrt(F.try_divide(a * (1 - a) + (m - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a), m * n))
    z = 1.959963984540054
    return out.select(
        by, "n", "n_pos", "auc", F.greatest(F.lit(0.0), a - z * se).alias("auc_lo"), F.least(F.lit(1.0), a + z * se).alias("auc_hi"), "ap", F.try_divide(F.col("ap"), F.col("n_pos") / F.col("n")).alias("ap_lift"), "ks", "brier", "accuracy",
        "precision_at_1pct", "precision_at_5pct", "precision_at_10pct",
    )


def multiclass(preds: DataFrame, by: str = "run_id", tie: str = "row_id") -> DataFrame:
    """auc, ap (both the plain mean of each class against the rest), accuracy, n, classes per run of (run_id, row_id, label, p).

    p: an array with a probability for each class; label: the row's own place in it. auc is null where a class has no row or all;
    a class without rows has an ap of 0. Each class is one run of the curves of two classes.
    """
    each = preds.where("label is not null and p is not null").select(by, tie, "label", F.posexplode("p").alias("_class", "_p"))
    one = each.select(F.struct(F.col(by).alias("run"), F.col("_class").alias("class")).alias("_rc"), tie, (F.col("label") == F.col("_class")).cast("int").alias("y"), F.col("_p").alias("p"))
    curves = classification(one, "_rc", tie).select(F.col("_rc.run").alias(by), "auc", F.coalesce("ap", F.lit(0.0)).alias("ap"), "n")
    hit = (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("int")
    right = preds.where("label is not null and p is not null").groupBy(by).agg(F.avg(hit).alias("accuracy"))
    all_there = F.when(F.count("auc") == F.count("*"), F.avg("auc"))
    return curves.groupBy(by).agg(all_there.alias("auc"), F.avg("ap").alias("ap"), F.max("n").alias("n"), F.count("*").cast("int").alias("classes")).join(right, by)


def over_folds(preds: DataFrame, by: str = "run_id", tie: str = "row_id", many: bool = False) -> DataFrame:
    """run_id, fold, n_test, pos_rate, auc (null for one class), ap (0 without ones) of (run_id, fold, row_id, y, p), in one plan for all folds.

    many: p is an array of all classes' probabilities and label the row's place in it; pos_rate is null.
    """
    one = preds.withColumn("_rf", F.struct(F.col(by).alias("run"), "fold")).drop(by, "fold")
    got = (multiclass if many else classification)(one, "_rf", tie)
    rate = F.lit(None).cast("double") if many else F.try_divide("n_pos", "n")
    return got.select(F.col("_rf.run").alias(by), F.col("_rf.fold").alias("fold"), F.col("n").alias("n_test"), rate.alias("pos_rate"), "auc", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def fold_summary(folds: DataFrame, by: str = "run_id") -> DataFrame:
    """auc and auc_median, auc_mean, auc_q025, auc_q975, ap (median), ap_mean, folds (those with an auc), pos_rate_test (median) per run."""
    q = lambda c, p: F.percentile(c, p)  # noqa: E731  a run has a handful of folds
    return folds.groupBy(by).agg(
        q("auc", 0.5).alias("auc"), q("auc", 0.5).alias("auc_median"), F.avg("auc").alias("auc_mean"), q("auc", 0.025).alias("auc_q025"), q("auc", 0.975).alias("auc_q975"),
        q("ap", 0.5).alias("ap"), F.avg("ap").alias("ap_mean"), F.count("auc").alias("folds"), q("pos_rate", 0.5).alias("pos_rate_test"), F.sum("n_test").alias("n_test"),
    )


def regression_over_folds(preds: DataFrame, by: str = "run_id") -> DataFrame:
    """Medians over folds of what regression() says of each, of (run_id, fold, y, p, y_train_mean)."""
    one = preds.withColumn("_rf", F.struct(F.col(by).alias("run"), "fold")).drop(by, "fold")
    got = regression(one, "_rf").withColumn(by, F.col("_rf.run"))
    return got.groupBy(by).agg(*[F.percentile(c, 0.5).alias(c) for c in got.columns if c not in (by, "_rf")], F.count("*").alias("folds"))


def at_threshold(preds: DataFrame, threshold: float = 0.5, by: str = "run_id") -> DataFrame:
    """Confusion counts, precision, recall, F1, MCC and accuracy per run."""
    hit = F.col("p") >= threshold
    g = preds.groupBy(by).agg(*[F.count_if(c).alias(k) for k, c in {"tp": hit & (F.col("y") == 1), "fp": hit & (F.col("y") == 0), "tn": ~hit & (F.col("y") == 0), "fn": ~hit & (F.col("y") == 1)}.items()])
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return g.select(by, "tp", "fp", "tn", "fn", z(F.try_divide(tp, tp + fp)).alias("precision"), z(F.try_divide(tp, tp + fn)).alias("recall"), z(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), z(F.try_divide(tp * tn - fp * fn, den)).alias("mcc"), F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def best_f1(preds: DataFrame, by: str = "run_id") -> DataFrame:
    """The score at which F1 is largest (of equal ones the larger), over all distinct scores."""
    c = preds.groupBy(by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    whole = c.groupBy(by).agg(F.sum("pos").alias("all_pos"))
    c = running_totals(c, [by], "p", {"tp": "pos", "upto": "n"}, down=True).join(whole, by)
    c = c.withColumn("f1", F.round(2 * F.col("tp") / (F.col("upto") + F.col("all_pos")), 12))
    return c.groupBy(by).agg(F.max(F.struct("f1", "p")).alias("b")).select(by, F.col("b.p").alias("threshold"), F.col("b.f1").alias("f1"))


def regression(preds: DataFrame, by: str = "run_id") -> DataFrame:
    """RMSE, MAE, R2, both skills and rank correlation of (run_id, y, p, y_train_mean)."""
    d = ranked(ranked(preds.where("y is not null and p is not null"), "y", "ry", [by]), "p", "rp", [by])
    e = F.col("y") - F.col("p")
    g = d.groupBy(by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("v"), F.avg((F.col("y") - F.col("y_train_mean")) * (F.col("y") - F.col("y_train_mean"))).alias("b"), corr("ry", "rp").alias("spearman"))
    return g.select(by, F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "v")).alias("r2"), F.sqrt("b").alias("baseline_rmse"), (1 - F.try_divide(F.sqrt("mse"), F.sqrt("b"))).alias("skill_rmse"), (1 - F.try_divide("mse", "v")).alias("skill_var"), "spearman")


def grade(auc: Column, ks: Column, brier: Column, lift: Column, rank: Column) -> Column:
    """0 to 5 from ramps of five metrics."""
    ramp = lambda c, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - lo) / (hi - lo)))
    return 5 * (0.30 * ramp(auc, 0.5, 0.8) + 0.20 * ramp(ks, 0.1, 0.6) + 0.20 * ramp(brier, 0.25, 0.05) + 0.15 * ramp(lift, 1.0, 1.2) + 0.15 * F.coalesce(rank, F.lit(0.0)))
