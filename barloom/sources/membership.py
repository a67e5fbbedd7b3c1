"""A stored, mergeable Bloom filter of keys, and the exact check of what it lets through.

Keys are hashed to 64 bits; the hash decides a shard and the bits in it. A shard is built for SHARD_KEYS keys, so its bitmap is a few
megabytes however many keys there are, and shards are built, merged and asked in tasks of their own. Equal hashes are counted as one before they
travel. The filter is a Parquet table (shard, bits) in numbered versions below its path; what it was made for is beside it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_KEYS = 1 << 22
BITS = "shard int, bits binary"


@dataclass(frozen=True)
class Shape:
    """Filters of one shape can be merged. capacity: keys for which the error rate holds."""

    capacity: int = 5_000_000
    error: float = 0.001
    shard_keys: int = SHARD_KEYS

    @property
    def shards(self) -> int:
        return -(-self.capacity // self.shard_keys)

    @property
    def bits(self) -> int:
        """Of one shard: those that the error rate needs, and a tenth more as shards fill unevenly."""
        each = self.capacity / self.shards
        return max(64, 8 * math.ceil(1.1 * each * -math.log(self.error) / math.log(2) ** 2 / 8))

    @property
    def hashes(self) -> int:
        return max(1, round(self.bits * self.shards / (1.1 * self.capacity) * math.log(2)))


def places(shape: Shape, h: np.ndarray) -> np.ndarray:
    """Keys by bits: where each hash sets its bits in its shard."""
    u = h.astype(np.int64).view(np.uint64)
    first, step = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(shape.hashes, dtype=np.uint64) * step[:, None]) % np.uint64(shape.bits)).astype(np.int64)


def _bitmap(shape: Shape, h: np.ndarray) -> np.ndarray:
    flags = np.zeros(shape.bits, bool)
    for at in range(0, len(h), 1 << 18):
        flags[places(shape, h[at : at + (1 << 18)]).ravel()] = True
    return np.packbits(flags)


def hashed(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


@dataclass
class Membership:
    """add() and merge() make a new version; contains() may say yes to a key that isn't there, at the shape's error rate, and never no to one that is."""

    spark: SparkSession
    path: str
    shape: Shape

    # ---- storage

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    @classmethod
    def create(cls, spark: SparkSession, path: str, capacity: int = 5_000_000, error: float = 0.001, shard_keys: int = SHARD_KEYS) -> Membership:
        out = cls(spark, path, Shape(capacity, error, shard_keys))
        fs, meta = out._fs(f"{path}/shape.json")
        stream = fs.create(meta, False)  # refused where there is a filter
        stream.write(bytearray(json.dumps({"capacity": capacity, "error": error, "shard_keys": shard_keys}).encode()))
        stream.close()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Membership:
        text = spark.read.text(f"{path}/shape.json", wholetext=True).first()[0]
        return cls(spark, path, Shape(**json.loads(text)))

    def version(self) -> int:
        """0: nothing added yet. A version counts once it was written to its end."""
        fs, jpath = self._fs(self.path)
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(jpath) if s.isDirectory() and fs.exists(self._fs(f"{self.path}/{s.getPath().getName()}/_SUCCESS")[1])]
        return max(done, default=0)

    def bitmaps(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(BITS).parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], BITS)

    def _write(self, parts: DataFrame) -> None:
        def either(key, rows: pd.DataFrame) -> pd.DataFrame:
            whole = np.zeros(-(-self_bits // 8), np.uint8)
            for b in rows["bits"]:
                whole |= np.frombuffer(b, np.uint8)
            return pd.DataFrame({"shard": [key[0]], "bits": [whole.tobytes()]})

        self_bits, v = self.shape.bits, self.version()
        parts.groupBy("shard").applyInPandas(either, BITS).write.parquet(f"{self.path}/v{v + 1}")

    # ---- use

    def _hashes(self, df: DataFrame, key: str) -> DataFrame:
        return df.select(hashed(key).alias("h")).where(F.col(key).isNotNull()).distinct().withColumn("shard", F.pmod(F.shiftright("h", 7), F.lit(self.shape.shards)).cast("int"))

    def add(self, df: DataFrame, key: str) -> None:
        """All keys of the column; null is no key."""
        shape = self.shape

        def build(k, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [k[0]], "bits": [_bitmap(shape, rows["h"].to_numpy()).tobytes()]})

        self._write(self.bitmaps().unionByName(self._hashes(df, key).groupBy("shard").applyInPandas(build, BITS)))

    def merge(self, other: Membership) -> None:
        if other.shape != self.shape:
            raise ValueError(f"{other.shape} can't be merged into {self.shape}")
        self._write(self.bitmaps().unionByName(other.bitmaps()))

    def contains(self, df: DataFrame, key: str, name: str = "maybe") -> DataFrame:
        """df with a flag: False where the key is surely not there."""
        shape = self.shape

        def ask(k, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
            h = rows["h"].to_numpy()
            if not len(bits):
                return pd.DataFrame({"_h": h, name: np.zeros(len(h), bool)})
            flags = np.unpackbits(np.frombuffer(bits["bits"].iloc[0], np.uint8)).astype(bool)
            said = np.concatenate([np.zeros(0, bool), *[flags[places(shape, h[at : at + (1 << 18)])].all(axis=1) for at in range(0, len(h), 1 << 18)]])
            return pd.DataFrame({"_h": h, name: said})

        answers = self._hashes(df, key).groupBy("shard").cogroup(self.bitmaps().groupBy("shard")).applyInPandas(ask, f"_h long, `{name}` boolean")
        return df.withColumn("_h", hashed(key)).join(answers, "_h", "left").drop("_h").withColumn(name, F.coalesce(name, F.lit(False)))

    def unseen(self, candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
        """Candidates whose key isn't among the known ones, which the filter was built from: only those that the filter lets through are looked up."""
        asked = self.contains(candidates, key, "_maybe")
        hits = asked.where("_maybe").drop("_maybe").join(known.select(key), key, "left_anti")
        return asked.where("not _maybe").drop("_maybe").unionByName(hits.select(*candidates.columns))
