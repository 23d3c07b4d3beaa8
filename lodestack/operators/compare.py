"""Comparing and profiling listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_parts


def listing_changes(old: DataFrame, new: DataFrame, key: str = "drive_file_id") -> DataFrame:
    """(key, change) with change added, removed, moved (same id, other path or name) or same."""
    o, n = old.select(key, F.struct("path", "name").alias("_o")), new.select(key, F.struct("path", "name").alias("_n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("moved")
    return both.select(key, change.alias("change"))


def compare(old: DataFrame, new: DataFrame, key: str = "drive_file_id", examples: int = 3) -> DataFrame:
    """(change, n, examples): the smallest ids of each kind, kept small while they are gathered."""
    from pyspark.sql.window import Window

    changes = listing_changes(old, new, key)
    first = changes.withColumn("_at", F.row_number().over(Window.partitionBy("change").orderBy(key))).where(F.col("_at") <= examples)
    shown = first.groupBy("change").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return changes.groupBy("change").agg(F.count("*").alias("n")).join(shown, "change")


def top_folder(path) -> F.Column:
    first = F.array_join(F.slice(path_parts(path), 1, 2), "/")
    return F.when(first == "", "(root)").otherwise(first)


def profile(files: DataFrame) -> DataFrame:
    """(kind, value, n): total, indexable, by first two path parts, by extension; in one pass."""
    rows = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")),
        F.when(F.col("is_indexable"), F.struct(F.lit("indexable").alias("kind"), F.lit("").alias("value"))),
        F.struct(F.lit("folder").alias("kind"), top_folder(F.col("path")).alias("value")),
        F.struct(F.lit("extension").alias("kind"), F.col("extension").alias("value")),
    )
    return files.select(F.explode(F.array_compact(rows)).alias("r")).groupBy("r.kind", "r.value").agg(F.count("*").alias("n"))
