"""Run history as an append-only log: a row for each change of a run's state, folded on reading."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.shared import create_exclusively

SCHEMA = "run_id string, seq long, run_key string, status string, started_at string, finished_at string, selection_json string, metrics_json string, artifacts_json string, error_msg string"
STATES = ("PENDING", "RUNNING", "SUCCESS", "FAILED")


def fold(log: DataFrame) -> DataFrame:
    """One row for each run: of every column the last value that was set."""
    cols = [c for c in log.columns if c not in ("run_id", "seq")]
    return log.groupBy("run_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in cols])


@dataclass
class RunLog:
    spark: SparkSession
    path: str

    def _append(self, **row) -> None:
        row["seq"] = time.time_ns()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        """All rows, or none where nothing has been written."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def runs(self) -> DataFrame:
        return fold(self.log())

    def _key_file(self, run_key: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}-keys/{run_key}")
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def exists(self, run_key: str) -> bool:
        """One look at a file, however long the log is."""
        fs, jpath = self._key_file(run_key)
        return fs.exists(jpath)

    def create(self, run_key: str, selection: dict) -> str:
        """A new run's id. A key that is on record is refused: an empty file of that name is made first, which only one of several writers can do."""
        if not create_exclusively(self.spark, f"{self.path}-keys/{run_key}"):
            raise ValueError(f"a run with key {run_key} is on record")
        run_id = uuid.uuid4().hex
        self._append(run_id=run_id, run_key=run_key, status="PENDING", selection_json=json.dumps(selection, sort_keys=True))
        return run_id

    def take_over(self, run_key: str, after: float = 3600.0) -> bool:
        """Free a key whose writer died between taking it and logging its run: it has no run and is older than `after` seconds. True where this call freed it."""
        fs, jpath = self._key_file(run_key)
        if not fs.exists(jpath) or time.time() - fs.getFileStatus(jpath).getModificationTime() / 1000 <= after:
            return False
        return self.log().where(F.col("run_key") == run_key).isEmpty() and fs.delete(jpath, False)

    def _now(self) -> str:
        return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def start(self, run_id: str) -> None:
        self._append(run_id=run_id, status="RUNNING", started_at=self._now())

    def succeed(self, run_id: str, metrics: dict, artifacts: dict | None = None) -> None:
        self._append(run_id=run_id, status="SUCCESS", finished_at=self._now(), metrics_json=json.dumps(metrics, sort_keys=True), artifacts_json=json.dumps(artifacts or {}, sort_keys=True))

    def fail(self, run_id: str, error: str) -> None:
        self._append(run_id=run_id, status="FAILED", finished_at=self._now(), error_msg=error)

    def selection(self, run_id: str) -> dict:
        """The selection of a run; eval_cfg is "default" where it was not given."""
        row = self.log().where((F.col("run_id") == run_id) & F.col("selection_json").isNotNull()).select("selection_json").first()
        if row is None:
            raise RuntimeError(f"no run {run_id}")
        return {"eval_cfg": "default"} | json.loads(row[0])

    def compact(self, to: str) -> "RunLog":
        """The folded log in a few files at a new path, with its keys: appends leave one small file each."""
        rows = self.runs().withColumn("seq", F.lit(time.time_ns()))
        rows.select(*[f.split()[0] for f in SCHEMA.split(", ")]).repartition(8).write.parquet(to)
        out = RunLog(self.spark, to)
        fs, keys = self._key_file("")
        if fs.exists(keys):
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, keys, fs, out._key_file("")[1], False, self.spark._jsc.hadoopConfiguration())
        return out
