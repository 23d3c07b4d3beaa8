"""A resumable run over files whose content is pending: fetch, read pages, OCR thin ones, gate, save batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, upsert
from ..operators.order import numbered
from ..scratch import forget, staged
from ..sources.files import MOST_BYTES
from ..sources.guard import Guarded, Unreadable

ATTEMPTS = 4
#: Files between two commits, and seconds that a reader has for a file (an engine for a page).
BATCH, SECONDS = 2000, 60


def fetched(key: str, fetch: Callable[[str], bytes], sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> bytes:
    """The file's bytes; an OSError is tried again after pauses. More than MOST_BYTES is a ValueError."""
    for k in range(attempts):
        try:
            data = fetch(key)
            break
        except OSError:
            if k == attempts - 1:
                raise
            sleep(2**k)
    if len(data) > MOST_BYTES:
        raise ValueError("too large")
    return data


def read_files(todo: DataFrame, fetch: Callable[[str], bytes], read: Callable[[bytes], list[str]], seconds: float = SECONDS) -> DataFrame:
    """(document_id, source_modified, page, text, outcome, error) of todo (id, drive_file_id, modified_on).

    outcome: read, failed (could not be fetched), unreadable (fetched, but no pages come of it); error says why. The
    reader runs in a process of its own: one that raises, dies or gives no answer within ``seconds`` makes the file
    unreadable and no more.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(Guarded(lambda: read, seconds)) as guarded:
            for batch in batches:
                for key, file, day in zip(batch["id"], batch["drive_file_id"], batch["modified_on"]):
                    pages, outcome, error = [""], "read", None
                    try:
                        pages = [str(p or "") for p in guarded(fetched(file, fetch))] or [""]
                    except OSError as e:
                        outcome, error = "failed", f"{type(e).__name__}: {e}"
                    except ValueError as e:
                        outcome, error = "unreadable", str(e)
                    n = len(pages)
                    yield pd.DataFrame({"document_id": [key] * n, "source_modified": [day] * n, "page": range(n), "text": pages, "outcome": [outcome] * n, "error": [error] * n})

    return todo.select("id", "drive_file_id", "modified_on").mapInPandas(work, "document_id long, source_modified date, page int, text string, outcome string, error string")


def with_scans(pages: DataFrame, todo: DataFrame, fetch: Callable[[str], bytes], engine: Callable[[], Callable[[bytes, int], str]], seconds: float = SECONDS) -> DataFrame:
    """pages of read_files with the first thin pages of each file read by OCR, and ``scanned``: whether a page was.

    Only files with thin pages are fetched again, dealt evenly over the tasks whatever read them first. The engine is
    made once in each task, in a process of its own. A page that it cannot read in time keeps its text layer; a file
    that cannot be fetched again keeps them all.
    """
    thin = content.pages_to_ocr(pages.where("outcome = 'read'").withColumnRenamed("document_id", "doc_id"))
    asked = thin.groupBy("doc_id").agg(F.collect_list("page").alias("pages"))  # a dozen of each file at most
    files = asked.join(todo.select(F.col("id").alias("doc_id"), "drive_file_id"), "doc_id").repartition("doc_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(Guarded(engine, seconds)) as guarded:
            for batch in batches:
                for key, file, asked in zip(batch["doc_id"], batch["drive_file_id"], batch["pages"]):
                    found = []
                    try:
                        data = fetched(file, fetch)
                        for page in asked:
                            try:
                                found.append((key, int(page), str(guarded(data, int(page)) or "")))
                            except Unreadable:
                                continue
                    except (OSError, ValueError):
                        pass
                    yield pd.DataFrame(found, columns=["document_id", "page", "ocr"])

    again = staged(files.mapInPandas(work, "document_id long, page int, ocr string"), "ocr")
    return pages.join(again, ["document_id", "page"], "left").select("document_id", "source_modified", "page", F.coalesce(F.nullif(F.trim("ocr"), F.lit("")), F.col("text")).alias("text"), "outcome", "error", F.col("ocr").isNotNull().alias("scanned"))


def texts_of(pages: DataFrame, at: str) -> DataFrame:
    """document_text rows of read and unreadable files; what was not fetched has none, so that it is pending again."""
    known = pages.where("outcome <> 'failed'")
    scanned = F.col("scanned") if "scanned" in pages.columns else F.lit(False)
    cover = content.coverage(known.withColumnRenamed("document_id", "doc_id")).withColumnRenamed("doc_id", "document_id")
    whole = known.groupBy("document_id").agg(
        F.first("source_modified").alias("source_modified"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"),
        F.when(F.bool_and(F.col("outcome") == "read"), F.when(F.bool_or(scanned), "ocr").otherwise("text")).otherwise("none").alias("method"),
    )
    return content.gate(whole.join(cover, "document_id")).withColumn("created_at", F.to_timestamp(F.lit(at)))


def in_order(todo: DataFrame, limit: int | None) -> DataFrame:
    """Pending files by place; with a limit the first of them."""
    ordered = todo.orderBy("path", "name", "id")
    return ordered if limit is None else ordered.limit(max(limit, 0))


def run(
    spark: SparkSession,
    root: str,
    doc_types: list[str],
    fetch: Callable[[str], bytes],
    read: Callable[[bytes], list[str]],
    at: str,
    limit: int | None = None,
    force: bool = False,
    ocr: Callable[[], Callable[[bytes, int], str]] | None = None,
    batch: int = BATCH,
    seconds: float = SECONDS,
) -> dict[str, int]:
    """Read pending files of a stored catalogue, by place, and save their texts; returns the number of files by outcome.

    Files are taken ``batch`` at a time, and every batch is committed under a manifest of its own, as a part beside the
    texts that are stored: a run that is broken off keeps its finished batches, and the next run takes up the others. A
    file that could not be fetched is pending again; unreadable files are remembered until they change. ``ocr`` makes an
    engine for thin pages; then the files whose thin pages it read are counted as ``ocr`` too.
    """
    tables = {t: upsert.current(spark, root, t) for t in ("documents", "raw_files", "document_text")}
    todo = numbered(content.pending(tables["documents"], tables["raw_files"], tables["document_text"], doc_types, force), [F.col("path"), F.col("name"), F.col("id")], "_at")
    todo = staged(todo.where(F.lit(True) if limit is None else F.col("_at") < max(limit, 0)), "pending")
    kinds = ("read", "failed", "unreadable", *(["ocr"] if ocr else []))
    total = dict.fromkeys(kinds, 0)
    for low in range(0, todo.count(), batch):
        part = todo.where(F.col("_at").between(low, low + batch - 1)).repartition(max(1, min(batch, 4 * spark.sparkContext.defaultParallelism)))
        pages = staged(read_files(part, fetch, read, seconds), "pages")
        if ocr:
            pages = staged(with_scans(pages, part, fetch, ocr, seconds), "scanned")
        fresh = texts_of(pages, at).select(*tables["document_text"].columns)
        upsert.append(spark, root, {"document_text": fresh})
        found = pages.groupBy("document_id").agg(F.min("outcome").alias("outcome"), *([F.bool_or("scanned").alias("scanned")] if ocr else []))
        counts = found.agg(*[F.count_if(F.col("outcome") == k if k != "ocr" else F.col("scanned")).alias(k) for k in kinds]).first()
        total = {k: total[k] + counts[k] for k in kinds}
        forget(pages)
    return total
