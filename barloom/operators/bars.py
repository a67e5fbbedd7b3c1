"""Ticks to gap-filled bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.exprs import by_time, finite

STEP = "5 minutes"
VOLUMES = ("volume", "quote_volume", "n_trades", "taker_buy_base_vol", "taker_buy_quote_vol")


def from_ticks(ticks: DataFrame, step: str = STEP) -> DataFrame:
    """series_id, ts and OHLCV of each step in which a series has a tick (series_id, ts, value)."""
    t = ticks.select("series_id", "ts", finite("value").alias("value")).where("value is not null")
    g = t.groupBy("series_id", F.window("ts", step).alias("bucket")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.round(F.sum("value"), 6).alias("volume"), F.count("*").cast("double").alias("n_trades"),
    )
    return g.select("series_id", F.col("bucket.start").alias("ts"), "open", "high", "low", "close", "volume", "n_trades")


def first_of_each(bars: DataFrame, position: str | None = None) -> DataFrame:
    """One row for each series and time: the first by position (by its values where the source has no position)."""
    order = [F.col(position)] if position else [F.col(c) for c in bars.columns if c not in ("series_id", "ts")]
    rank = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy(*order))
    return bars.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def on_grid(time: str, step: str, up: bool) -> str:
    """The time, moved up or down to a multiple of step since 1970."""
    t = pd.Timestamp(time)
    return str(t.ceil(pd.Timedelta(step)) if up else t.floor(pd.Timedelta(step)))


def fill(bars: DataFrame, step: str = STEP, start: str | None = None, until: str | None = None) -> DataFrame:
    """Every step from a series' first bar (or `start`) to its last bar (or to `until`, at most now).

    Rows off the grid are dropped; a bar with any price missing takes the last close for all four; what has volume gets 0 there.
    Adds bar_idx, is_gap, gap_len, is_imputed_price and, with a volume column, is_imputed_volume.
    """
    kind = bars.schema["ts"].dataType
    first, last = F.min("ts"), F.max("ts")
    if start is not None:
        first = F.lit(on_grid(start, step, True)).cast(kind)
    if until is not None:
        last = F.least(F.lit(on_grid(until, step, False)).cast(kind), F.date_trunc("minute", F.current_timestamp()).cast(kind))
    spine = bars.groupBy("series_id").agg(first.alias("t0"), last.alias("t1")).where("t0 <= t1")
    spine = spine.select("series_id", F.explode(F.expr(f"sequence(t0, t1, interval {step})")).alias("ts"))
    df = spine.join(bars, ["series_id", "ts"], "left")
    w = Window.partitionBy("series_id").orderBy("ts")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    before = F.last("close", ignorenulls=True).over(cum)
    df = df.withColumns({"bar_idx": (F.row_number().over(w) - 1).cast("long"), "_missing": missing, "_before": before, "is_gap": F.col("open").isNull()})
    changes = {c: F.when(F.col("_missing"), F.col("_before")).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    volumes = [c for c in VOLUMES if c in bars.columns]
    changes |= {c: F.when(F.col("_missing"), F.lit(0.0)).otherwise(F.col(c)) for c in volumes}
    changes["is_imputed_price"] = F.col("_missing")
    if volumes:
        changes["is_imputed_volume"] = F.col("_missing")
    df = df.withColumns(changes)
    # the number of the last bar that is no gap makes each gap an island
    anchor = F.coalesce(F.max(F.when(~F.col("is_gap"), F.col("bar_idx"))).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    return df.withColumn("gap_len", F.when(F.col("is_gap"), F.col("bar_idx") - anchor).otherwise(0).cast("int")).drop("_missing", "_before")


def event_bars(events: DataFrame) -> DataFrame:
    """Bars of the events table: one series for each event type."""
    return fill(from_ticks(events.select(F.col("event_type").alias("series_id"), "ts", "value")))


BARS_SQL = """
raw as (select event_type as series_id, time_bucket(interval 5 minutes, ts) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low,
               arg_max(value, ts) as close, round(sum(value), 6) as volume, count(*)::double as n_trades from events where value is not null group by 1, 2),
spine as (select series_id, unnest(generate_series(min(ts), max(ts), interval 5 minutes)) as ts from raw group by series_id),
joined as (select s.series_id, s.ts, open, high, low, close, volume, n_trades, open is null as is_gap,
                  last_value(close ignore nulls) over (partition by s.series_id order by s.ts rows unbounded preceding) as before,
                  row_number() over (partition by s.series_id order by s.ts) - 1 as bar_idx
           from spine s left join raw r on s.series_id = r.series_id and s.ts = r.ts),
bars as (select series_id, ts, bar_idx, case when is_gap then before else open end as open, case when is_gap then before else high end as high,
                case when is_gap then before else low end as low, case when is_gap then before else close end as close,
                case when is_gap then 0.0 else volume end as volume, case when is_gap then 0.0 else n_trades end as n_trades, is_gap,
                case when is_gap then bar_idx - coalesce(max(case when not is_gap then bar_idx end) over (partition by series_id order by ts rows unbounded preceding), -1) else 0 end::int as gap_len
         from joined)"""


def gapped_event_bars(events: DataFrame, lead: str = "200 minutes") -> DataFrame:
    """The same bars with a calendar that begins earlier than any tick, a high that is infinite in some bars, and a close that is missing in others.

    Infinities are null from ingestion on, and a bar with a missing price is filled like one without ticks.
    """
    raw = from_ticks(events.select(F.col("event_type").alias("series_id"), "ts", "value"))
    step = F.floor(F.unix_timestamp("ts") / 300)
    raw = raw.withColumns({"high": finite(F.when(step % 97 == 5, float("inf")).otherwise(F.col("high"))), "close": F.when(step % 89 != 7, F.col("close"))})
    start = raw.agg((F.min("ts") - F.expr(f"interval {lead}")).cast("string")).first()[0]
    return fill(raw, start=start)


GAPPED_BARS_SQL = BARS_SQL.replace("\nraw as (", "\nticked as (", 1).replace(
    "\nspine as (select series_id, unnest(generate_series(min(ts), max(ts), interval 5 minutes)) as ts from raw group by series_id),",
    """
raw as (select * replace (case when epoch(ts) // 300 % 97 = 5 then null else high end as high, case when epoch(ts) // 300 % 89 <> 7 then close end as close) from ticked),
spine as (select series_id, unnest(generate_series((select min(ts) - interval 200 minutes from raw), max(ts), interval 5 minutes)) as ts from raw group by series_id),""",
).replace("open is null as is_gap,", "open is null or high is null or low is null or close is null as is_gap,")
