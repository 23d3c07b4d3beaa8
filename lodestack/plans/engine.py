"""The verbs of the engine over a catalogue in memory and one on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import stacks, upsert
from ..operators.catalog import MOST_ALIASES, Catalog, Result
from ..operators.facets import Filters
from ..scratch import staged
from .chat import Form, Parsed, parse
from .planner import Plan, Planner


class Engine:
    def __init__(self, catalog: Catalog, resolve_course: Callable[[str], list[str]] | None = None):
        self.catalog, self.planner, self.resolve = catalog, Planner(catalog), resolve_course

    def search(self, query: str = "", filters: Filters | None = None) -> Result:
        if len(query) > 200:
            raise ValueError("a query has at most 200 characters")
        for facet in ("course", "doc_type", "exam_type", "year"):
            if filters and len(filters.values(facet)) > 20:
                raise ValueError(f"at most 20 values of {facet}")
        if filters and any(not 2000 <= y <= 2100 for y in filters.values("year")):
            raise ValueError("years go from 2000 to 2100")
        return self.catalog.search(query, filters)

    def page(self, result: Result, number: int = 0, size: int = 20) -> DataFrame:
        if not 0 <= number <= 50:
            raise ValueError("pages go from 0 to 50")
        return stacks.page(stacks.stacks(result.hits), number * size, size)

    def cards(self, result: Result) -> DataFrame:
        return stacks.cards(result.hits)

    def suggest(self, prefix: str, limit: int = 8) -> DataFrame:
        return self.catalog.suggest(prefix, limit)

    def chat_parse(self, message: str, previous: Form | None = None) -> Parsed:
        return parse(message, self.catalog.aliases, previous)

    def reply(self, message: str, previous: Form | None = None) -> tuple[str, Parsed, int | None]:
        """(kind, what was read, estimated files): smalltalk, unclear, clarify or confirm."""
        read = self.chat_parse(message, previous)
        if read.smalltalk:
            return "smalltalk", read, None
        if not read.understood:
            return "unclear", read, None
        if not read.form.courses and self.resolve and (codes := [c for c in self.resolve(message) if c in set(self.catalog.aliases.values())][:3]):
            from dataclasses import replace

            read = replace(read, form=replace(read.form, courses=tuple(codes)))
        if not read.form.courses:
            return "clarify", read, None
        return "confirm", read, self.planner.run(read.form).hits.count()

    def plan(self, form: Form) -> Plan:
        return self.planner.run(form)


def sync(spark: SparkSession, root: str, files: DataFrame, source_id: int, seen_at: str, retire: bool = False, force: bool = False) -> dict[str, int]:
    """One sync of a listing into a stored catalogue: guard, upsert, retire, then one manifest for all that changed."""
    now = F.to_timestamp(F.lit(seen_at))
    old = upsert.current(spark, root, "raw_files")
    batch = files.withColumn("source_id", F.lit(source_id).cast("long")).withColumn("ordinal", F.monotonically_increasing_id()).withColumn("id", F.xxhash64("drive_file_id"))
    listed, known = batch.count(), old.where(F.col("source_id") == source_id).count()
    if retire and upsert.partial_listing(known, listed, force):
        raise ValueError(f"the listing has {listed} files but {known} are stored; nothing was changed")
    counts = upsert.upsert_counts(old, batch, "drive_file_id").first().asDict()
    files_now = staged(upsert.upsert_raw_files(old, batch, now), "raw_files")
    changed = {"raw_files": files_now, "sources": upsert.mark_synced(upsert.current(spark, root, "sources"), source_id, now)}
    counts |= {"retired": 0, "restored": 0}
    if retire:
        before = upsert.current(spark, root, "documents")
        changed["documents"] = staged(upsert.retire_unseen(before, files_now, source_id, now), "documents")
        counts |= upsert.retire_counts(before, changed["documents"]).first().asDict()
    upsert.publish_all(spark, root, changed)
    return counts


def extract(spark: SparkSession, root: str, at: str) -> int:
    """Rules over all indexable files into documents, keeping what a person reviewed; returns the number of documents."""
    aliases = upsert.current(spark, root, "course_aliases")
    if aliases.limit(MOST_ALIASES + 1).count() > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} nicknames of courses")
    known = aliases.agg(F.map_from_entries(F.collect_list(F.struct("alias_norm", "course_id"))).alias("m"))
    files = upsert.current(spark, root, "raw_files").where("is_indexable").join(F.broadcast(known))
    read = rules.extract(files, F.col("m"))
    new = read.select(
        F.xxhash64("drive_file_id").alias("id"), F.col("id").alias("raw_file_id"), F.col("course").alias("course_id"), "title", F.col("url").alias("drive_url"), "mime_type", "academic_year", "semester", "instructor",
        "exam_type", "exam_number", "doc_type", "is_makeup", "has_solution", "syllabus_scope", F.lit(None).cast("string").alias("content_hash"), F.lit("unknown").alias("link_status"),
        F.col("method").alias("extraction_method"), F.col("confidence").alias("extraction_confidence"), F.array_join("notes", "; ").alias("extraction_notes"), F.lit(False).alias("reviewed"), F.to_timestamp(F.lit(at)).alias("created_at"),
    )
    upsert.publish(upsert.upsert_documents(upsert.current(spark, root, "documents"), new), root, "documents")
    return upsert.current(spark, root, "documents").count()


def document_view(documents: DataFrame, raw_files: DataFrame, courses: DataFrame) -> DataFrame:
    """Visible documents with their file and course, in path order."""
    r = raw_files.select(F.col("id").alias("raw_file_id"), "drive_file_id", "path", "name", "url")
    c = courses.select(F.col("id").alias("course_id"), F.col("code").alias("course_code"), F.col("name").alias("course_name"))
    both = documents.where("link_status <> 'broken'").join(r, "raw_file_id").join(c, "course_id", "left")
    return both.select(
        F.col("id").alias("doc_id"), "drive_file_id", "path", "name", "url", "doc_type", "exam_type", "exam_number", "academic_year", "is_makeup", "has_solution",
        F.col("extraction_confidence").alias("confidence"), F.col("extraction_method").alias("method"), F.coalesce("course_code", F.lit("")).alias("course_code"), F.coalesce("course_name", F.lit("")).alias("course_name"),
        "semester", F.coalesce("instructor", F.lit("")).alias("instructor"), "syllabus_scope",
    )
