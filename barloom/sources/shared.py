"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_made: list[tuple[object, object]] = []


def _drop_made() -> None:
    for fs, path in _made:
        try:
            fs.delete(path, True)
        except Exception:  # the session may be gone at exit
            return


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (in a local session without one, below a folder of our own), removed when the driver's process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/barloom-{os.getpid()}"
    path = f"{root.rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not _made:
        atexit.register(_drop_made)
    _made.append((jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath))
    return path


def create_exclusively(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False where it is there already. Of several callers at once one gets True.

    Stores with atomic creation (as HDFS has) do this by themselves; on a local or mounted file system the operating system does.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        file = spark._jvm.java.io.File(jpath.toUri().getPath())
        file.getParentFile().mkdirs()
        return file.createNewFile()
    try:
        fs.create(jpath, False).close()
    except Py4JJavaError as error:
        if fs.exists(jpath):
            return False
        raise error
    return True
