"""The registry of queries and of the SQL that says the same, and pieces of both that several modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.sources.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_ROWS = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly where much is computed of each row and it is read in fewer parts than there are cores, or than it takes to have SPREAD_ROWS rows in each."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= parts else df.repartition(parts)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what several branches of a plan need is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_bars(table(spark, sf_dir, "events"))


def gapped_bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.gapped_event_bars(table(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of places (and no negative zero), so that engines agree to the last bit shown.

    A shift below the last place keeps decimal inputs off the halves, where the last bit of a sum would decide.
    """
    return df.select(*[(F.round(F.col(c) + 3e-7, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


GAPPED = B.GAPPED_BARS_SQL
WHOLE_GAPPED = GAPPED.replace("\nbars as (", "\nwhole_bars as (", 1)


def over_bars(name: str, make: Callable[[DataFrame], DataFrame], columns: dict[str, str] | None = None, before: str = "", source: str = "bars", digits: int = 6, ints: tuple[str, ...] = (), raw: tuple[str, ...] = (), gapped: bool | str = False):
    """Register a per-bar family: make in Spark, and for DuckDB an expression for each column.

    gapped: and once more, as <name>_gapped, over bars that begin with a gap and have missing and infinite prices. A text makes CTE bars of whole_bars.
    """
    sql = None
    if columns is not None:
        cells = [f"{e} as {c}" if c in raw else f"({e})::int as {c}" if c in ints else f"round(({e})::double + 3e-7, {digits}) + 0.0 as {c}" for c, e in columns.items()]
        sql = f"with recursive {B.BARS_SQL}{before} select series_id, bar_idx, {', '.join(cells)} from {source}"
    query(name, sql)(lambda spark, sf_dir: rounded(make(bars_of(spark, sf_dir)), digits))
    if gapped:
        source_sql = GAPPED if gapped is True else f"{WHOLE_GAPPED}, {gapped}"
        query(f"{name}_gapped", sql.replace(B.BARS_SQL, source_sql))(lambda spark, sf_dir: rounded(make(gapped_bars_of(spark, sf_dir)), digits))


W = "partition by series_id order by bar_idx"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({W})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) over ({W})"


def roll(f: str, n: int) -> str:
    return f"{f} over ({W} rows {n - 1} preceding)"


def z(x: str) -> str:
    return f"coalesce({x}, 0.0)"


def d(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


PRICES = f""",
typical as (select *, (high + low + close) / 3 as hlc3 from bars),
priced as (select * exclude (raw_vwap), coalesce(last_value(raw_vwap ignore nulls) over ({W} rows unbounded preceding), first_value(raw_vwap ignore nulls) over ({W} rows between unbounded preceding and unbounded following)) as vwap from
  (select *, sum(hlc3 * volume) over ({W} rows unbounded preceding) / nullif(sum(volume) over ({W} rows unbounded preceding), 0) as raw_vwap from typical))"""
