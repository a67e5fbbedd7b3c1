"""A store of datasets, computed columns and artifacts, in any folder that Spark can write to."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B

#: (symbol, period, start, end) -> raw bars with series_id, ts and prices.
Fetch = Callable[[str, str, str, str], DataFrame]


def iso_date(text: str) -> str:
    """YYYYMMDD as midnight of that day; anything else as it is."""
    return f"{text[:4]}-{text[4:6]}-{text[6:]} 00:00:00" if re.fullmatch(r"\d{8}", text) else text


def dataset_parts(name: str) -> tuple[str, str, str, str]:
    """symbol, period, start and end of a dataset's name, joined by underscores in it."""
    parts = name.split("_", 3)
    if len(parts) != 4:
        raise FileNotFoundError(f"{name!r} is neither stored nor of the form symbol_period_start_end")
    return parts[0], parts[1], iso_date(parts[2]), iso_date(parts[3])


def as_folder(name: str) -> str:
    """A folder's name for any text: what isn't a letter, digit, dot, dash or underscore is written as ~ and its code."""
    return re.sub(r"[^A-Za-z0-9._-]", lambda m: f"~{ord(m.group()):x}~", name)


def as_name(folder: str) -> str:
    return re.sub(r"~([0-9a-f]+)~", lambda m: chr(int(m.group(1), 16)), folder)


@dataclass
class Store:
    """Folders below root: datasets/<name>, columns/<dataset>/<kind>/<name>, artifacts/<dataset>/<tag>; all Parquet.

    Each write of a table makes a version of its own in the table's folder, and a mark when it is complete; readers take the
    newest complete one. So a reader never meets half a table or none, and writers don't meet each other. The version
    before the newest stays for those who still read it.
    """

    spark: SparkSession
    root: str
    fetch: Fetch | None = None

    # ---- files

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *map(as_folder, parts)])

    def _exists(self, path: str) -> bool:
        fs, jpath = self._fs(path)
        return fs.exists(jpath)

    def _versions(self, path: str) -> list[str]:
        """The complete versions of a table, the newest last."""
        fs, jpath = self._fs(path)
        found = sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []
        return [v for v in found if v.startswith("v") and self._exists(f"{path}/{v}/_complete")]

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{path}/{self._versions(path)[-1]}")

    def _names(self, path: str) -> list[str]:
        fs, jpath = self._fs(path)
        found = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
        return sorted(as_name(n) for n in found if not n.startswith("_"))

    def _put(self, df: DataFrame, path: str) -> None:
        own = f"{path}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(own)
        fs, mark = self._fs(f"{own}/_complete")
        fs.create(mark).close()
        for old in self._versions(path)[:-2]:
            fs.delete(self._fs(f"{path}/{old}")[1], True)

    # ---- datasets

    def exists(self, name: str) -> bool:
        return bool(self._versions(self._at("datasets", name)))

    def save(self, name: str, df: DataFrame) -> None:
        self._put(df, self._at("datasets", name))

    def datasets(self) -> list[str]:
        return self._names(self._at("datasets"))

    def load(self, name: str) -> DataFrame:
        """A Parquet path as it is; else what is stored; else fetched, gap-filled and stored."""
        if name.endswith(".parquet") and self._exists(name):
            return self.spark.read.parquet(name)
        return self._read(self._at("datasets", name)) if self.exists(name) else self.refresh(name)

    def refresh(self, name: str) -> DataFrame:
        """Fetch and gap-fill again, over what is stored. A path cannot be refreshed."""
        if name.endswith(".parquet"):
            raise FileNotFoundError(f"{name} is a path; only datasets with a name can be refreshed")
        symbol, period, start, end = dataset_parts(name)
        if self.fetch is None:
            raise FileNotFoundError(f"{name!r} is not stored, and no source is set to fetch it from")
        raw = self.fetch(symbol, period, start, end)
        raw = raw.withColumn("_position", F.monotonically_increasing_id())  # the order in which the source gave them
        self.save(name, B.fill(B.first_of_each(raw, "_position").drop("_position"), start=start, until=end))
        return self._read(self._at("datasets", name))

    # ---- columns: features and targets

    def save_column(self, dataset: str, kind: str, name: str, df: DataFrame) -> None:
        """df: series_id, bar_idx and the column `name`, stored as value."""
        self._put(df.select("series_id", "bar_idx", F.col(f"`{name}`").alias("value")), self._at("columns", dataset, kind, name))

    def column_exists(self, dataset: str, kind: str, name: str) -> bool:
        return bool(self._versions(self._at("columns", dataset, kind, name)))

    def load_column(self, dataset: str, kind: str, name: str) -> DataFrame:
        if not self.column_exists(dataset, kind, name):
            raise FileNotFoundError(f"{kind} {name!r} of {dataset!r} is not stored")
        return self._read(self._at("columns", dataset, kind, name)).withColumnRenamed("value", name)

    def columns(self, dataset: str, kind: str) -> list[str]:
        return self._names(self._at("columns", dataset, kind))

    def predictions(self, dataset: str) -> list[str]:
        """Stored out-of-fold predictions, which may serve as features."""
        return [n for n in self.columns(dataset, "feature") if n.startswith("pred_") and "__oof" in n]

    def missing(self, dataset: str, target: str, features: list[str]) -> list[str]:
        """What of a selection isn't stored."""
        here = set(self.columns(dataset, "feature"))
        return [*([] if self.column_exists(dataset, "target", target) else [target]), *[f for f in features if f not in here]]

    def best_dataset(self, target: str, features: list[str]) -> str | None:
        """The dataset that has the target and most of the features; of equals, the first by name."""
        have = [(len(set(features) & set(self.columns(d, "feature"))), d) for d in self._names(self._at("columns")) if self.column_exists(d, "target", target)]
        return min(have, key=lambda x: (-x[0], x[1]))[1] if have else None

    # ---- artifacts

    def artifact(self, bars: DataFrame, dataset: str, tag: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stored artifact; made again where it has fewer rows than bars or ends at another bar, per series."""
        path = self._at("artifacts", dataset, tag)
        shape = lambda df: df.groupBy("series_id").agg(F.count("*").alias("n"), F.max("bar_idx").alias("last"))
        if self._versions(path):
            stored = self._read(path)
            old = shape(stored).select("series_id", F.col("n").alias("n0"), F.col("last").alias("last0"))
            if shape(bars).join(old, "series_id", "left").where("n0 is null or n0 < n or last0 <> last").isEmpty():
                return stored
        self._put(make(bars), path)
        return self._read(path)
