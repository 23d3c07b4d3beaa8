"""Shared helpers: table access, shared scratch tables, Arrow batch plumbing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a temporary folder is made and remembered for the session.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lodestack.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("lodestack.scratch", path)
    return path.rstrip("/")


_run = f"run-{uuid.uuid4().hex}"
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
    except Exception:  # the JVM has gone already
        shutil.rmtree(base.removeprefix("file:"), ignore_errors=True)


_stage: int | None = None
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """A worker process's own object, kept between the tasks of one stage and let go when another stage begins."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _enter_stage() -> None:
    global _stage
    if (now := TaskContext.get().stageId()) != _stage:
        _kept.clear()
        _stage = now


def by_batch(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def of_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter_stage()
        yield from work(batches)

    return df.mapInArrow(of_stage, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null becomes the empty text."""
    return [t or "" for t in batch.column(name).to_numpy(zero_copy_only=False).tolist()]


#: Bits of a sieve at most (128 MiB).
SIEVE = 1 << 30


def sieve(wanted: DataFrame, name: str) -> np.ndarray:
    """A bitmap of the wanted ids' hash positions: 16 to 32 bits for each id, but never more than SIEVE bits.

    Spark builds it in pieces of 4 KiB; its size has a fixed bound, so it may go to the driver and be broadcast. The
    lowest bit of an id does not count.
    """
    bits = 1 << max(15, min((16 * wanted.count()).bit_length(), SIEVE.bit_length() - 1))
    at = F.shiftrightunsigned(name, 1).bitwiseAND(F.lit(bits - 1)) + 1  # the functions number positions from 1
    pieces = wanted.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
    out = np.zeros((bits >> 15, 4096), dtype=np.uint8)
    for piece, bitmap in pieces.collect():
        out[piece - 1] = np.frombuffer(bitmap, dtype=np.uint8)
    return out


def members_of(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the ids that may be wanted."""
    at = ids.view(np.uint64) >> np.uint64(1) & np.uint64((len(bitmap) << 15) - 1)
    piece, bit = (at >> np.uint64(15)).astype(np.int64), (at & np.uint64(32767)).astype(np.int64)
    return np.flatnonzero(bitmap[piece, bit >> 3] >> (bit & 7) & 1)


def running_number(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """Number rows 0, 1, ... in a global order without a single-task window.

    Rows are dealt by range; each range is numbered on its own and shifted by the row counts of the ranges before it.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), tag)
    inside = Window.partitionBy("_part").orderBy(*order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return dealt.withColumn("_at", F.row_number().over(inside)).join(parts, "_part").withColumn(name, F.col("_at") - 1 + F.col("_shift")).drop("_part", "_at", "_shift")
