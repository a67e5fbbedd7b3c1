"""Column helpers that fix, in one place, how missing values, divisions and windows behave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("series_id", "bar_idx")


def by_time():
    return Window.partitionBy("series_id").orderBy("bar_idx")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """x as DOUBLE; NaN and infinities become null."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def div(a, b) -> Column:
    """a / b; null where b is 0 or either is missing."""
    return F.try_divide(col(a), col(b))


def corr(x, y) -> Column:
    """Pearson's correlation of an aggregate's pairs; null where either side doesn't vary (the built-in divides by 0 there)."""
    x, y = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def zero(x) -> Column:
    return F.coalesce(col(x), F.lit(0.0))


def clip(x, lo: float, hi: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def roll(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def cum():
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def ffill(x) -> Column:
    return F.last(col(x), ignorenulls=True).over(cum())


def pct_change(x) -> Column:
    return div(x, F.lag(col(x)).over(by_time())) - 1


def sliding(df: DataFrame, n: int, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds aggregates over the last n rows (fewer at a series' start) in time that does not depend on n.

    specs: name -> (max | min | sum | count, column). Rows are cut into blocks of n; a window is the end of one block and the
    beginning of the next, so running aggregates from both block edges suffice. Sums add at most n values: nothing cancels.
    """
    blk, off = F.floor(F.col("bar_idx") / n), F.col("bar_idx") % n
    df = df.withColumns({"_blk": blk, "_off": off, **{f"_x_{k}": c for k, (_, c) in specs.items()}})
    part = Window.partitionBy("series_id", "_blk")
    ahead = part.orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    back = part.orderBy(F.col("bar_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    agg = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    df = df.withColumns({f"_p_{k}": agg[f](f"_x_{k}").over(ahead) for k, (f, _) in specs.items()})
    df = df.withColumns({f"_s_{k}": agg[f](f"_x_{k}").over(back) for k, (f, _) in specs.items()})
    out = {}
    for k, (f, _) in specs.items():
        head, tail = F.col(f"_p_{k}"), F.lag(f"_s_{k}", n - 1).over(by_time())
        if f in ("max", "min"):
            both = (F.greatest if f == "max" else F.least)(head, tail)
        else:
            both = F.when(head.isNull(), tail).when(tail.isNull(), head).otherwise(head + tail)
        out[k] = F.when(F.col("_off") == n - 1, head).otherwise(both)
    return df.withColumns(out).drop("_blk", "_off", *[f"_{p}_{k}" for p in "xps" for k in specs])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
