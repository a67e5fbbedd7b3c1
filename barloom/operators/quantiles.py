"""Exact quantiles of groups of any size: the values around a rank are found by counting buckets that keep the order of values.

A first pass counts values by sign, exponent and 12 bits of mantissa; that is some thousands of counts for a group, added up where the values lie. It
says which bucket holds a rank. A second pass counts the values of those buckets by 16 bits more, and a third the single values of what is left,
equal ones as one row. So no task ever holds a group's values, and only the first pass looks at all of them.

A table of at most FEW values, by count, takes one pass instead: a task that held all of them would need some tens of megabytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.exprs import col
from barloom.operators.scan import written
from barloom.operators.scores import value_bucket


FEW = 1 << 21


def fine_bucket(x: Column) -> Column:
    """The next 16 bits of mantissa behind those of value_bucket, in the order of values within it."""
    size = F.abs(x.cast("double"))
    place = (size / F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1e-300))))) - 1) * 4096
    return F.when(size < 1e-300, F.lit(0)).otherwise(F.signum(x.cast("double")) * F.floor((place - F.floor(place)) * 65536)).cast("long")


def _chosen(counted: DataFrame, within: list[str], step: str, ranks: DataFrame) -> DataFrame:
    """ranks (within, want, rank) with the step whose values hold the rank, and the rank among these."""
    order = Window.partitionBy(*within).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", F.sum("_c").over(order))
    found = upto.join(ranks, within).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank")))
    return found.select(*within, step, "want", (F.col("rank") - (F.col("_upto") - F.col("_c"))).alias("rank"))


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column | str, float]], stored: bool = False) -> DataFrame:
    """The columns by, and for each name the quantile (column, share) of the group's values, interpolated between neighbours; null without values.

    Only groups with a value of some column have a row. Keys may be null. stored: df is a table, which each pass may read; else its values are written first.
    """
    sources: dict[str, int] = {}
    exprs: list[Column] = []
    for c, _ in wanted.values():
        key = c if isinstance(c, str) else str(c)
        if key not in sources:
            sources[key] = len(exprs)
            exprs.append(col(c).cast("double"))
    of = {name: sources[c if isinstance(c, str) else str(c)] for name, (c, _) in wanted.items()}
    group = F.struct(*by, F.lit(0).alias("_all"))  # a struct with null fields equals itself
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("v"), e.alias("x")) for i, e in enumerate(exprs)])).alias("_e")
    long = df.select(group.alias("_g"), each).select("_g", "_e.v", "_e.x").where(F.col("x").isNotNull())
    long = (long if stored else written(long, "values")).withColumns({"b0": value_bucket(F.col("x")), "b1": fine_bucket(F.col("x"))})

    if long.count() <= FEW:
        few = long.groupBy("_g").agg(*[F.percentile(F.when(F.col("v") == of[name], F.col("x")), p).alias(name) for name, (_, p) in wanted.items()])
        return few.select(*[F.col(f"_g.{c}").alias(c) for c in by], *wanted)
    counted = long.groupBy("_g", "v", "b0").agg(F.count("*").alias("_c"))
    n = counted.groupBy("_g", "v").agg(F.sum("_c").alias("n"))
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(of[name]).alias("w"), F.lit(p).alias("p")) for k, (name, (_, p)) in enumerate(wanted.items())])).alias("_q")
    place = (F.col("n") - 1) * F.col("_q.p")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("_s")
    ranks = n.select("_g", "v", "n", asks).where("_q.w = v").select("_g", "v", (place - F.floor(place)).alias("share"), "_q.k", sides)
    ranks = ranks.select("_g", "v", F.struct("k", "_s.side", "share").alias("want"), F.col("_s.rank").alias("rank"))

    first = _chosen(counted, ["_g", "v"], "b0", ranks)
    inside = lambda found, keys: long.join(found.select(*keys).distinct(), keys, "left_semi")
    at = ["_g", "v", "b0"]
    second = _chosen(inside(first, at).groupBy(*at, "b1").agg(F.count("*").alias("_c")), at, "b1", first)
    at = [*at, "b1"]
    third = _chosen(inside(second, at).groupBy(*at, "x").agg(F.count("*").alias("_c")), at, "x", second)
    out = []
    for k, name in enumerate(wanted):
        end = lambda side, k=k: F.max(F.when((F.col("want.k") == k) & (F.col("want.side") == side), F.col("x")))
        share = F.max(F.when(F.col("want.k") == k, F.col("want.share")))
        out.append(F.when(end(0) == end(1), end(0)).otherwise(end(0) * (1 - share) + end(1) * share).alias(name))
    return third.groupBy("_g").agg(*out).select(*[F.col(f"_g.{c}").alias(c) for c in by], *wanted)


def with_quantiles(df: DataFrame, by: list[str], found: DataFrame) -> DataFrame:
    """df, one row a group, and the quantiles of the same groups; null where a group has none. Keys may be null."""
    names = [c for c in found.columns if c not in by]
    right = found.select(F.struct(*by).alias("_k"), *names)
    return df.withColumn("_k", F.struct(*by)).join(right, "_k", "left").drop("_k")
