"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, in local mode, a temporary folder remembered for the session."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lodestack.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("lodestack.scratch", path)
    return path.rstrip("/")


_run = f"engine-{uuid.uuid4().hex}"
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_swept: set[str] = set()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, lost executors recompute nothing before it.

    Tables lie in a folder of this process, which goes when the process ends; ``forget`` lets one go before.
    """
    spark = df.sparkSession
    base = f"{scratch(spark)}/{_run}"
    if base not in _swept:
        _swept.add(base)
        atexit.register(_sweep, spark, base)
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        if path := _places.pop(t, None):
            remove(t.sparkSession, path)


def _sweep(spark: SparkSession, base: str) -> None:
    try:
        remove(spark, base)
    except Exception:  # the JVM has gone already; a remote store keeps what only it can delete
        shutil.rmtree(base.removeprefix("file:"), ignore_errors=True)
