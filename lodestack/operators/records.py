"""Listings, lookups and counts over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_alias
from .order import numbered
from .upsert import upsert

#: Columns that documents may be counted by.
COUNTABLE = ("doc_type", "exam_type", "extraction_method", "link_status", "academic_year", "method")


def with_files(rows: DataFrame, documents: DataFrame, raw_files: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows about documents with the document (confidence, kind) and its file (path, name, url)."""
    d = documents.select(F.col("id").alias(key), "raw_file_id", "title", "doc_type", "exam_type", "course_id", "extraction_confidence", "extraction_notes")
    r = raw_files.select(F.col("id").alias("raw_file_id"), "path", "name", "url")
    return rows.join(d, key).join(r, "raw_file_id")


def review_order() -> list[Column]:
    """The least certain first, unknown confidence before all; then by place."""
    return [F.col("extraction_confidence").asc_nulls_first(), F.col("path"), F.col("name"), F.col("document_id")]


def open_reviews(queue: DataFrame, documents: DataFrame, raw_files: DataFrame) -> DataFrame:
    """What a person should look at: open entries with their document and file, in review order."""
    return with_files(queue.where("status = 'open'"), documents, raw_files).orderBy(*review_order())


def recent_reports(reports: DataFrame, documents: DataFrame, raw_files: DataFrame, limit: int) -> DataFrame:
    """The newest reports with their documents; later ids first among equal times."""
    found = with_files(reports, documents, raw_files).withColumnRenamed("id", "report_id")
    return found.orderBy(F.desc("created_at"), F.desc("report_id")).limit(max(limit, 0))


def file_kinds(documents: DataFrame, raw_files: DataFrame, courses: DataFrame) -> DataFrame:
    """(doc_id, drive_file_id, extension, doc_type, course_code) of visible documents, in path order."""
    r = raw_files.select(F.col("id").alias("raw_file_id"), "drive_file_id", "extension", "path", "name")
    c = courses.select(F.col("id").alias("course_id"), F.col("code").alias("course_code"))
    both = documents.where("link_status <> 'broken'").join(r, "raw_file_id").join(c, "course_id", "left")
    kinds = both.select(F.col("id").alias("doc_id"), "drive_file_id", "extension", "doc_type", F.coalesce("course_code", F.lit("")).alias("course_code"), "path", "name")
    return kinds.orderBy("path", "name", "doc_id").drop("path", "name")


def raw_in_order(raw_files: DataFrame) -> DataFrame:
    return raw_files.orderBy("path", "name", "drive_file_id")


def ids_by_raw_file(documents: DataFrame) -> DataFrame:
    """(raw_file_id, document_id, reviewed): what an extraction joins to find earlier documents."""
    return documents.select("raw_file_id", F.col("id").alias("document_id"), "reviewed")


def model_answers(documents: DataFrame) -> DataFrame:
    """Earlier answers of the language model that nobody has reviewed, by raw file; they are not asked for again."""
    rows = documents.where((F.col("extraction_method") == "llm") & ~F.col("reviewed"))
    return rows.select("raw_file_id", "doc_type", "exam_type", "exam_number", "is_makeup", "extraction_confidence", "extraction_notes")


def named_aliases(aliases: DataFrame, courses: DataFrame) -> DataFrame:
    """(alias, code, name): nicknames of courses that exist."""
    c = courses.select(F.col("id").alias("course_id"), "code", "name")
    return aliases.join(c, "course_id").select("alias", "code", "name")


def resolved(texts: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """texts with the course_id that each names, or null; compared without case, spaces and marks."""
    known = aliases.select("alias_norm", "course_id").dropDuplicates(["alias_norm"])
    return texts.withColumn("alias_norm", normalize_alias(F.col(text))).join(known, "alias_norm", "left").drop("alias_norm")


def count_by(rows: DataFrame, column: str, allowed: tuple[str, ...] = COUNTABLE) -> DataFrame:
    """(column, n), the largest first; only columns that may be counted."""
    if column not in allowed:
        raise ValueError(f"cannot count by {column}")
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def table_counts(raw_files: DataFrame, queue: DataFrame, log: DataFrame, source_id: int) -> DataFrame:
    """One row: files, those that are indexed, those of a source, open reviews, log entries."""
    files = raw_files.agg(F.count("*").alias("files"), F.count_if("is_indexable").alias("indexable"), F.count_if(F.col("source_id") == source_id).alias("of_source"))
    opened = queue.agg(F.count_if(F.col("status") == "open").alias("open_reviews"))
    return files.join(opened).join(log.agg(F.count("*").alias("log_entries")))  # three single rows


def counts_by_method(texts: DataFrame) -> DataFrame:
    return texts.groupBy("method").agg(F.count("*").alias("n"))


def methods_by_type(view: DataFrame) -> DataFrame:
    """(doc_type, rule, llm, manual, share): how documents of a type got it, and the share that rules did not."""
    count = lambda m: F.count_if(F.col("method") == m).alias(m)
    return view.groupBy("doc_type").agg(count("rule"), count("llm"), count("manual"), F.avg((F.col("method") != "rule").cast("double")).alias("share"))


def collection_summary(view: DataFrame, sure: float = 0.8) -> DataFrame:
    """One row (n, labelled, sure): documents, the share with a known type, the share read with confidence."""
    share = lambda c: F.avg(c.cast("double"))
    return view.agg(F.count("*").alias("n"), share(F.col("doc_type") != "unknown").alias("labelled"), share(F.col("confidence") >= sure).alias("sure"))


def median_chars(view: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_type, median_chars, n) from sizes (doc_id, n_chars)."""
    return view.join(sizes, "doc_id").groupBy("doc_type").agg(F.median("n_chars").alias("median_chars"), F.count("*").alias("n"))


def leading(view: DataFrame, group: str, column: str, most: int) -> DataFrame:
    """(group, column, n): of each group the values found most often."""
    counted = view.groupBy(group, column).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), column))
    return counted.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def appended_log(log: DataFrame, entries: DataFrame, by: list[Column]) -> DataFrame:
    """The log with new entries, numbered on from its largest id in the given order."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(entries, by, "_at").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_at") + 1)
    return log.unionByName(fresh.select(*log.columns))


def saved_texts(stored: DataFrame, read: DataFrame) -> DataFrame:
    """document_text after a read: new texts replace those of the same document, others stay."""
    return upsert(stored, read, "document_id")
