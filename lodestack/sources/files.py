"""File sources: every CSV is read as text with a fixed schema, then parsed and checked by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.listing import drive_file_id, file_extension, is_indexable, modified_date, or_null
from ..functions.text import normalize_alias
from ..operators.measure import FIELDS
from ..vocabulary import DEFAULT_MATERIALS, DOC_TYPES, EXAM_TYPES, MATERIALS, SCOPES

KINDS = ["smalltalk", "unclear", "clarify", "confirm"]


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with header (a byte-order mark is fine), all columns text; missing required columns are an error."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in df.columns])


def listing(rows: DataFrame) -> DataFrame:
    """Listing rows (path, name, mime_type, modified, url) as raw files, with ``bad``: why a row is to be skipped, or null."""
    ext = file_extension(F.col("name"))
    day = modified_date(F.col("modified"))
    bad = F.when(drive_file_id(F.col("url")).isNull(), "no id in the link").when((F.trim("modified") != "") & day.isNull(), "not a date")
    return rows.select(
        drive_file_id(F.col("url")).alias("drive_file_id"), "path", "name", ext.alias("extension"), "mime_type", day.alias("modified_on"), "url",
        is_indexable(ext, F.col("mime_type"), F.col("path")).alias("is_indexable"), bad.alias("bad"),
    )


def read_listing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raw files, skipped rows with the reason)."""
    rows = listing(read_csv(spark, path, ["path", "name", "mime_type", "modified", "url"]))
    return rows.where("bad is null").drop("bad"), rows.where("bad is not null")


def corpus(files: DataFrame) -> DataFrame:
    """Indexable files numbered from 0 by path and name. The number is a display position, not an identity."""
    from pyspark.sql.window import Window

    kept = files.where("is_indexable")
    part = kept.repartitionByRange("path", "name", "drive_file_id").withColumn("_p", F.spark_partition_id())
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_p").orderBy("path", "name", "drive_file_id")) - 1
    return part.join(sizes.select("_p", before.alias("_b")), "_p").withColumn("doc_id", (at + F.col("_b")).cast("long")).drop("_p", "_b")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["query", "must_contain_name", "must_contain_path"]).where("query <> ''")


def is_relevant(name, path, must_name, must_path) -> F.Column:
    """Both texts occur, whatever the case; an empty one always does."""
    has = lambda text, part: F.contains(F.lower(text), F.lower(F.coalesce(part, F.lit(""))))
    return has(name, must_name) & has(path, must_path)


def chat_cases(rows: DataFrame) -> DataFrame:
    """Chat cases with lists split; ``bad`` tells what is wrong with a row, or null."""
    items = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs])
    material = F.when(F.col("materials") == "default", fixed(DEFAULT_MATERIALS)).when(F.col("materials") == "all", fixed(MATERIALS)).otherwise(items(F.col("materials")))
    number = lambda c: F.when(F.col(c) != "", F.col(c).try_cast("int"))
    years = F.transform(items(F.col("years")), lambda y: y.try_cast("int"))
    wrong = (
        F.when(~F.col("kind").isin(KINDS), "unknown kind")
        .when(F.exists(years, lambda y: y.isNull()), "not a year")
        .when((F.col("recent_years") != "") & number("recent_years").isNull(), "recent_years is no number")
        .when((F.col("quiz_number") != "") & number("quiz_number").isNull(), "quiz_number is no number")
    )
    return rows.select(
        "message", "previous_message", "kind", items(F.col("courses")).alias("courses"), items(F.col("exam_types")).alias("exam_types"), material.alias("materials"),
        years.alias("years"), number("recent_years").alias("recent_years"), items(F.col("topics")).alias("topics"), number("quiz_number").alias("quiz_number"), wrong.alias("bad"),
    )


def seeds(rows: DataFrame) -> DataFrame:
    """(alias_norm, alias, code, name, department, verified): the row's nickname, its code and its full name are all aliases."""
    all_ = rows.select(F.explode(F.array("alias", "course_code", "course_name")).alias("alias"), F.col("course_code").alias("code"), F.col("course_name").alias("name"), "department", F.lower("verified").isin("yes", "true", "1").alias("verified"))
    named = all_.withColumn("alias_norm", normalize_alias(F.col("alias"))).where("alias_norm <> ''")
    return named.groupBy("alias_norm", "code").agg(F.min("alias").alias("alias"), F.min("name").alias("name"), F.min("department").alias("department"), F.max("verified").alias("verified"))


def review_rows(rows: DataFrame) -> DataFrame:
    """Edited review rows with typed values and ``errors``; nothing may be written unless all errors are empty."""
    flag = lambda c: F.when(F.lower(c).isin("yes", "no", ""), F.lower(c) == "yes")
    ranged = lambda c, a, b: (F.col(c) == "") | F.coalesce(F.col(c).try_cast("int").between(a, b), F.lit(False))
    relevant = F.col("doc_type").isin("pyq", "solution", "unknown")
    errors = F.array_compact(
        F.array(
            F.when(~F.col("doc_type").isin(DOC_TYPES), "doc_type"),
            F.when(~F.col("exam_type").isin(EXAM_TYPES), "exam_type"),
            F.when((F.col("doc_type") == "unknown") | (relevant & (F.col("exam_type") == "unknown")), "unknown left"),
            F.when(~ranged("exam_number", 1, 20), "exam_number"),
            F.when(~ranged("academic_year", 2000, 2100), "academic_year"),
            F.when(flag(F.col("is_makeup")).isNull(), "is_makeup"),
            F.when(flag(F.col("has_solution")).isNull(), "has_solution"),
            F.when(~F.col("syllabus_scope").isin("", *SCOPES), "syllabus_scope"),
        )
    )
    return rows.select(
        "drive_file_id", "doc_type", "exam_type", F.col("exam_number").try_cast("int").alias("exam_number"), F.col("academic_year").try_cast("int").alias("academic_year"),
        flag(F.col("is_makeup")).alias("is_makeup"), flag(F.col("has_solution")).alias("has_solution"), or_null(F.col("syllabus_scope")).alias("syllabus_scope"), errors.alias("errors"),
    )


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Corrections of a review file; the whole file is checked before any row is returned."""
    rows = review_rows(read_csv(spark, path, ["drive_file_id", "doc_type", "exam_type", "exam_number", "academic_year", "is_makeup", "has_solution", "syllabus_scope"]))
    bad = rows.where(F.size("errors") > 0).select("drive_file_id", "errors").limit(10).collect()
    if bad:
        raise ValueError(f"review rows with errors: {[tuple(b) for b in bad]}")
    return rows.drop("errors")


def write_review(queue: DataFrame, path: str) -> None:
    """Open items for a person, least certain first, as one CSV file (a work list is small)."""
    yes_no = lambda c: F.when(F.col(c), "yes").otherwise("no").alias(c)
    rows = queue.orderBy(F.col("confidence").asc_nulls_first(), "path", "name")
    out = rows.select("drive_file_id", "reason", "path", "name", "url", "doc_type", "exam_type", "exam_number", "academic_year", yes_no("is_makeup"), yes_no("has_solution"), "syllabus_scope")
    out.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_sheet(sheet: DataFrame, path: str) -> None:
    columns = [*sheet.columns, "correct", *[f"fix_{f}" for f in FIELDS], "comment"]
    full = sheet.select("*", *[F.lit("").alias(c) for c in columns[len(sheet.columns) :]])
    full.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


#: Bytes of a file that is read at most.
MOST_BYTES = 25 * 1024 * 1024


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet that a person filled in, as ``measure.label_accuracy`` and ``measure.sheet_problems`` take it."""
    return read_csv(spark, path, ["stratum", "doc_id", "correct", *[f"pred_{f}" for f in FIELDS], *[f"fix_{f}" for f in FIELDS]])


def read_bytes(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, content) of files up to a size."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("path", "content")
