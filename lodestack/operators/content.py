"""Reading what is inside files: what is pending, which pages need OCR, the quality gate, the probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import non_space_chars, text_quality

MIN_PAGE_CHARS, OCR_PAGES, SNIPPET = 80, 12, 120
MIN_COVERAGE, MIN_QUALITY = 0.5, 0.65


def pending(documents: DataFrame, raw_files: DataFrame, texts: DataFrame, doc_types: list[str], force: bool = False) -> DataFrame:
    """Visible PDFs of the given types that have no text yet or changed since it was read (null-safe); no types, no work."""
    d = documents.where((F.col("link_status") != "broken") & F.col("doc_type").isin(doc_types)) if doc_types else documents.limit(0)
    r = raw_files.where("extension = 'pdf'").select(F.col("id").alias("raw_file_id"), "modified_on", "path", "name", "drive_file_id")
    t = texts.select(F.col("document_id").alias("id"), "source_modified", F.lit(True).alias("_read"))
    both = d.join(r, "raw_file_id").join(t, "id", "left")
    todo = F.lit(True) if force else F.col("_read").isNull() | ~F.col("source_modified").eqNullSafe(F.col("modified_on"))
    return both.where(todo).select("id", "drive_file_id", "path", "name", "modified_on")


def pages_to_ocr(pages: DataFrame, most: int = OCR_PAGES) -> DataFrame:
    """(doc_id, page) of the first pages whose text layer is too thin."""
    thin = pages.where(non_space_chars(F.col("text")) < MIN_PAGE_CHARS)
    return thin.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("_at") <= most).select("doc_id", "page")


def coverage(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, coverage, chars): the share of pages with enough text."""
    n = non_space_chars(F.col("text"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg((n >= MIN_PAGE_CHARS).cast("double")).alias("coverage"), F.sum(n).alias("chars"))


def gate(read: DataFrame) -> DataFrame:
    """read (text, method, coverage, ...) with quality; text that fails coverage or quality is dropped, its method none."""
    scored = read.withColumn("quality", text_quality(F.col("text")))
    good = (F.col("coverage") >= MIN_COVERAGE) & (F.col("quality") >= MIN_QUALITY)
    return scored.withColumn("method", F.when(good, F.col("method")).otherwise("none")).withColumn("text", F.when(good, F.col("text")).otherwise(""))


def probe(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, pages, chars, snippet): text if at least 0.8 of the pages have text, scanned if at most 0.2, else
    mixed; encrypted or error where reading failed (``error``, if pages has it); snippet: its first SNIPPET characters."""
    failed = F.max("error") if "error" in pages.columns else F.max(F.lit(None).cast("string"))
    first = F.min_by(F.regexp_replace(F.trim("text"), r"\s+", " "), "page") if "page" in pages.columns else F.min("text")
    share = F.col("coverage")
    both = coverage(pages).join(pages.groupBy("doc_id").agg(failed.alias("_error"), F.substring(F.coalesce(first, F.lit("")), 1, SNIPPET).alias("snippet")), "doc_id")
    kind = F.when(F.lower("_error").contains("encrypt"), "encrypted").when(F.col("_error").isNotNull(), "error").when(share >= 0.8, "text").when(share <= 0.2, "scanned").otherwise("mixed")
    return both.withColumn("kind", kind).drop("_error")


def searchable(texts: DataFrame, documents: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """(document_id, text) good enough to search, of visible documents."""
    visible = documents.where("link_status <> 'broken'").select(F.col("id").alias("document_id"))
    return texts.where((F.col("method") != "none") & (F.col("quality") >= min_quality)).join(visible, "document_id", "left_semi").select("document_id", "text")
