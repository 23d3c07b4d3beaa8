"""Global numbers and batches without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import staged


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order: dealt by range, numbered in each range, shifted by the ranges before it.

    Ties are numbered in any order, so ``order`` should end with a key.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_shift")
    return dealt.join(F.broadcast(shift), "_range").withColumn(name, place.cast("long")).drop("_range", "_shift")


def batches(df: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Rows with the number of their batch of ``size``, in order."""
    return numbered(df, order, "_at").withColumn(name, F.floor(F.col("_at") / size)).drop("_at")
