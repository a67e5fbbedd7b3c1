"""Bars from a stream of ticks, tail scoring for each batch, and smoothing that carries its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators import bars as B


def closed_bars(ticks: DataFrame, late: str = "10 minutes", step: str = B.STEP) -> DataFrame:
    """Bars of a stream of ticks (series_id, ts, value): each once, when no tick that is at most `late` can change it.

    A watermark needs a TIMESTAMP; times without a zone are taken and given back in the session's, which should be UTC.
    """
    kind = ticks.schema["ts"].dataType
    bars = B.from_ticks(ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), step)
    return bars.withColumn("ts", F.col("ts").cast(kind))


def tail(bars: DataFrame, rows: int) -> DataFrame:
    """The last rows of each series."""
    last = Window.partitionBy("series_id").orderBy(F.desc("bar_idx"))
    return bars.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= rows).drop("_back")


def _at(spark, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _exists(spark, path: str) -> bool:
    fs, jpath = _at(spark, path)
    return fs.exists(jpath)


def _drop(spark, path: str) -> None:
    fs, jpath = _at(spark, path)
    fs.delete(jpath, True)


def score_tail(bars: DataFrame, stored: str, checkpoint: str, score: Callable[[DataFrame, int], None], rows: int = 2000, **trigger) -> StreamingQuery:
    """Keep the closed bars of a stream at `stored`; after each batch give score the last rows of each series, gap-filled.

    score gets (tail, batch id) and may refit, predict and write. A batch reads its own bars and the tail that the batch before
    it left at `<stored>-tail`, never all that is stored. A batch that is run again after a failure replaces its own part of
    both, so no bar is there twice.
    """
    names = bars.columns

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{stored}/batch={batch_id}")
        own, before, here = (f"{x}/batch={k}" for x, k in ((stored, batch_id), (f"{stored}-tail", batch_id - 1), (f"{stored}-tail", batch_id)))
        known = spark.read.schema(batch.schema).parquet(own)
        if _exists(spark, before):
            known = known.unionByName(spark.read.schema(batch.schema).parquet(before))
        elif batch_id:  # a tail that is lost is made again from what is stored
            known = spark.read.parquet(stored).where(F.col("batch") <= batch_id)
        # as many stored bars as wanted are enough: gaps only add rows between them
        last = Window.partitionBy("series_id").orderBy(F.desc("ts"))
        known.select(*names).withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= rows).drop("_back").write.mode("overwrite").parquet(here)
        _drop(spark, f"{stored}-tail/batch={batch_id - 2}")
        score(tail(B.fill(spark.read.schema(batch.schema).parquet(here)), rows), batch_id)

    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def smoothed(rows: DataFrame, alpha: float, value: str = "close") -> DataFrame:
    """series_id, ts, value and its exponential mean, of a stream: each series' last mean is the state.

    Rows of a batch are taken in order of time; rows must not arrive in a later batch than younger ones, which holds for
    what closed_bars emits. A missing value keeps the mean.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
        mean, out = state.get[0] if state.exists else None, []
        for v in d["value"].tolist():
            if v == v:
                mean = v if mean is None else (1 - alpha) * mean + alpha * v
            out.append(mean)
        if mean is not None:
            state.update((mean,))
        yield pd.DataFrame({"series_id": key[0], "ts": d["ts"], "value": d["value"], "ewm": pd.Series(out, dtype="float64")})

    src = rows.select("series_id", "ts", F.col(value).cast("double").alias("value"))
    kind = src.schema["ts"].dataType.simpleString()
    return src.groupBy("series_id").applyInPandasWithState(step, f"series_id string, ts {kind}, value double, ewm double", "mean double", "append", GroupStateTimeout.NoTimeout)
