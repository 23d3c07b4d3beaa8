"""Idempotent writes as snapshot transformations: old rows, new rows, next rows.

There is no MERGE on plain Parquet; a full outer join by a unique key gives the next snapshot; publish_all() writes snapshots and then one manifest over all tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_alias
from ..schemas import ACTIVITY, KEYS, SCHEMA_VERSION, TABLES
from .order import numbered


def keep_last(batch: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key, by ordinal; a partial aggregation, so a hot key is cheap."""
    others = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*others), ordinal).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = (), guard: Column | None = None) -> DataFrame:
    """Rows of old overlaid by new. ``keep``: columns an existing row keeps; ``guard`` (over old's columns): rows that
    stay as they are. Columns that new lacks keep the old value, or null in inserted rows. Keys are unique on both sides."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    has_old, has_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    locked = has_old & guard if guard is not None else F.lit(False)

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"o.{key}", f"n.{key}").alias(c)
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        stays = ~has_new | locked | (has_old & F.lit(c in keep))
        return F.when(stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def upsert_counts(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row (seen, inserted, updated); repeats inside the batch count as updates."""
    fresh = batch.select(key).distinct().join(old.select(key), key, "left_anti").agg(F.count("*").alias("inserted"))
    return batch.agg(F.count("*").alias("seen")).join(fresh).select("seen", "inserted", (F.col("seen") - F.col("inserted")).alias("updated"))


def get_or_create(dimension: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """dimension (id, name) with rows for names it lacks, numbered on from the largest id."""
    fresh = names.select(name).distinct().join(dimension.select(name), name, "left_anti")
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    made = numbered(fresh, [F.col(name)], "_at").join(F.broadcast(top)).select((F.col("_top") + F.col("_at") + 1).cast("long").alias("id"), name)
    return dimension.select("id", name).unionByName(made)


def upsert_raw_files(old: DataFrame, batch: DataFrame, seen_at: Column) -> DataFrame:
    """The next raw_files: new values win, first_seen_at stays, last_seen_at moves."""
    new = keep_last(batch, "drive_file_id", "ordinal").drop("ordinal").withColumn("first_seen_at", seen_at).withColumn("last_seen_at", seen_at)
    return upsert(old, new, "drive_file_id", keep=["first_seen_at"])


def retire_unseen(documents: DataFrame, raw_files: DataFrame, source_id: int, seen_at: Column) -> DataFrame:
    """documents with link_status broken where their file vanished from the source, ok where it came back."""
    seen = raw_files.where(F.col("source_id") == source_id).select(F.col("id").alias("raw_file_id"), (F.col("last_seen_at") >= seen_at).alias("_seen"))
    both = documents.join(seen, "raw_file_id", "left")
    status = F.when(~F.col("_seen"), "broken").when(F.col("_seen") & (F.col("link_status") == "broken"), "ok").otherwise(F.col("link_status"))
    return both.withColumn("link_status", status).select(*documents.columns)


def retire_counts(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row (retired, restored)."""
    both = before.select(key, F.col("link_status").alias("was")).join(after.select(key, F.col("link_status").alias("now")), key)
    return both.agg(F.count_if(F.expr("was <> 'broken' and now = 'broken'")).alias("retired"), F.count_if(F.expr("was = 'broken' and now = 'ok'")).alias("restored"))


def partial_listing(known: int, listed: int, force: bool = False) -> bool:
    """Whether a listing is so much smaller than what is stored that a sync must refuse it."""
    return not force and known >= 20 and listed < 0.5 * known


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extracted metadata over documents; rows that a person reviewed stay, and so do created_at, link_status, content_hash."""
    return upsert(old, new, "raw_file_id", keep=["id", "created_at", "link_status", "content_hash"], guard=F.col("o.reviewed"))


EDITABLE = ["doc_type", "exam_type", "exam_number", "academic_year", "is_makeup", "has_solution", "syllabus_scope"]


def mark_manual(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """A person's corrections (id and some of EDITABLE; null: no change) make rows manual, certain and reviewed."""
    if unknown := set(corrections.columns) - {"id", *EDITABLE}:
        raise ValueError(f"columns that cannot be corrected: {sorted(unknown)}")
    c = corrections.select("id", *[F.col(x).alias(f"_{x}") for x in corrections.columns if x != "id"], F.lit(True).alias("_fixed"))
    fixed = F.coalesce("_fixed", F.lit(False))
    new = {x: F.coalesce(F.col(f"_{x}"), F.col(x)) for x in corrections.columns if x != "id"}
    new |= {"extraction_method": F.when(fixed, "manual").otherwise(F.col("extraction_method"))}
    new |= {"extraction_confidence": F.when(fixed, 1.0).otherwise(F.col("extraction_confidence")), "reviewed": fixed | F.col("reviewed")}
    return documents.join(c, "id", "left").select(*[new.get(x, F.col(x)).alias(x) for x in documents.columns])


def upsert_courses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Courses by code: name and department follow the new rows (code, name, department_id), ids stay, new ones go on."""
    named = get_or_create(old.select("id", F.col("code").alias("name")), new.select(F.col("code").alias("name"))).withColumnRenamed("name", "code")
    fresh = keep_last(new.withColumn("_at", F.monotonically_increasing_id()), "code", "_at").drop("_at").join(named, "code")
    return upsert(old, fresh.select(*old.columns), "id")


def add_aliases(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next aliases, conflicts). Rows: alias, course_id, verified. A nickname of two courses is a conflict, an empty
    one is refused; a known one is refreshed."""
    fresh = new.withColumn("alias_norm", normalize_alias(F.col("alias"))).where("alias_norm <> ''").dropDuplicates(["alias_norm", "course_id"])
    every = old.select("alias_norm", "course_id").unionByName(fresh.select("alias_norm", "course_id"))
    conflicts = every.groupBy("alias_norm").agg(F.count_distinct("course_id").alias("courses")).where("courses > 1")
    usable = fresh.join(conflicts.select("alias_norm"), "alias_norm", "left_anti")
    return upsert(old, usable, "alias_norm"), conflicts


def sync_queue(queue: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Review queue after an extraction: entries (document_id, reason) are opened or reopened, open rows without an entry
    resolve; created_at stays; other rows stay. Adds newly_opened and auto_resolved."""
    both = queue.alias("q").join(entries.alias("e"), F.col("q.document_id") == F.col("e.document_id"), "full_outer")
    was_open = F.coalesce(F.col("q.status") == "open", F.lit(False))
    has = F.col("e.document_id").isNotNull()
    return both.select(
        F.coalesce("q.document_id", "e.document_id").alias("document_id"),
        F.coalesce("e.reason", "q.reason").alias("reason"),
        F.when(has, "open").otherwise("resolved").alias("status"),
        F.coalesce("q.created_at", now).alias("created_at"),
        F.when(has, F.lit(None)).when(was_open, now).otherwise(F.col("q.resolved_at")).cast("timestamp").alias("resolved_at"),
        (has & ~was_open).alias("newly_opened"),
        (~has & was_open).alias("auto_resolved"),
    )


def resolve_queue(queue: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Open rows of the given documents become resolved."""
    ids = documents.select("document_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "open")
    both = queue.join(ids, "document_id", "left")
    new = {"status": F.when(hit, "resolved").otherwise(F.col("status")), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at"))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in queue.columns])


def mark_synced(sources: DataFrame, source_id: int, at: Column) -> DataFrame:
    return sources.withColumn("last_synced_at", F.when(F.col("id") == source_id, at).otherwise(F.col("last_synced_at")))


def requests_by_day(log: DataFrame, at: str = "at") -> DataFrame:
    """Requests by quota day, from an append-only log."""
    from ..functions.listing import quota_day

    return log.groupBy(quota_day(F.col(at)).alias("day")).agg(F.count("*").alias("requests"))


def remaining(usage: DataFrame, limit: int) -> DataFrame:
    return usage.select("day", F.greatest(F.lit(0), limit - F.col("requests")).alias("remaining"))


@dataclass(frozen=True)
class Part:
    """One written piece of a table; a later part's rows replace those of the same key in earlier ones."""

    version: str
    rows: int


@dataclass(frozen=True)
class Manifest:
    """The parts of every table as of one commit, written with one schema version."""

    number: int
    schema: int
    tables: dict[str, list[Part]]


def publish_all(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Write next snapshots beside the others, then one manifest that names every table's current one.

    Manifests are numbered and never changed, and only complete ones are read: a reader, and whoever comes after a
    crash, finds the old state or the new one, of all tables together. Two writers at once: the second fails.
    """
    last = _checked(_manifest(spark, root))
    _commit(spark, root, last, {table: [_written(df, root, table)] for table, df in tables.items()})


def publish(df: DataFrame, root: str, table: str) -> None:
    publish_all(df.sparkSession, root, {table: df})


def append(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Commit rows that are added to keyed tables or replace rows there (schemas.KEYS), without writing the tables again.

    The rows become a part of their own. Before that, trailing parts that are no larger than what is added are written
    into it, so a table of n rows has about log2(n) parts and a row is written as often at most.
    """
    last = _checked(_manifest(spark, root))
    changed = {}
    for table, df in tables.items():
        key, parts = KEYS[table], list(last.tables.get(table, []))
        fresh = _written(df, root, table)
        if not fresh.rows:
            continue
        merged = [fresh]
        while parts and parts[-1].rows <= sum(p.rows for p in merged):
            merged.insert(0, parts.pop())
        changed[table] = [*parts, fresh if len(merged) == 1 else _written(_overlaid(spark, root, table, merged, key), root, table)]
    if changed:
        _commit(spark, root, last, changed)


def _written(df: DataFrame, root: str, table: str) -> Part:
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{table}/{version}")
    return Part(version, df.sparkSession.read.parquet(f"{root}/{table}/{version}").count())


def _commit(spark: SparkSession, root: str, last: Manifest, changed: dict[str, list[Part]]) -> None:
    rows = [(t, p.version, SCHEMA_VERSION, k, p.rows) for t, parts in sorted((last.tables | changed).items()) for k, p in enumerate(parts)]
    spark.createDataFrame(rows, "name string, version string, schema_version int, part int, rows long").coalesce(1).write.mode("error").parquet(f"{root}/_manifest/{last.number + 1:012d}")


def _manifest(spark: SparkSession, root: str) -> Manifest:
    """The newest complete manifest; number 0 and no tables for none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    numbers = [int(f.getPath().getParent().getName()) for f in found]
    if not numbers:
        return Manifest(0, SCHEMA_VERSION, {})
    rows = [r.asDict() for r in spark.read.parquet(f"{root}/_manifest/{max(numbers):012d}").collect()]  # a row for each part
    tables: dict[str, list[Part]] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r.get("part") or 0)):
        # manifests of earlier releases have one part a table and do not count it: too large to be merged
        tables.setdefault(r["name"], []).append(Part(r["version"], r.get("rows", 1 << 62)))
    return Manifest(max(numbers), max(r["schema_version"] for r in rows), tables)


def _checked(found: Manifest) -> Manifest:
    if found.schema != SCHEMA_VERSION:
        hint = "migrate it first" if found.schema < SCHEMA_VERSION else "read it with its own release"
        raise ValueError(f"the catalogue was written with schema {found.schema}, not {SCHEMA_VERSION}; {hint}")
    return found


def _overlaid(spark: SparkSession, root: str, table: str, parts: list[Part], key: str | None) -> DataFrame:
    """Rows of all parts but those whose key is in a later one."""
    frames = [spark.read.parquet(f"{root}/{table}/{p.version}") for p in parts]
    out, later = frames[-1], frames[-1]
    for frame in reversed(frames[:-1]):
        out = frame.join(later.select(key), key, "left_anti").select(*frame.columns).unionByName(out, allowMissingColumns=True)
        later = later.select(key).unionByName(frame.select(key))
    return out


def _opened(spark: SparkSession, root: str, found: Manifest, table: str) -> DataFrame:
    if table not in found.tables:
        raise ValueError(f"{root} has no table {table}")
    return _overlaid(spark, root, table, found.tables[table], KEYS.get(table))


def current(spark: SparkSession, root: str, table: str) -> DataFrame:
    return _opened(spark, root, _checked(_manifest(spark, root)), table)


def _from_1(tables: dict[str, DataFrame], empty: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """Version 1 had other documents, which cannot be told into the columns of today; reports and logs point at them."""
    if "documents" in tables and (n := tables["documents"].count()):
        raise ValueError(f"cannot migrate: the old documents table holds {n} rows; keep a copy of the catalogue, remove that table and load it again")
    return {name: empty(name) for name in ("documents", "reports", "search_logs")}


#: version -> what changes on the way to the next one: all tables as they are to those that are written anew.
STEPS: dict[int, Callable[[dict[str, DataFrame], Callable[[str], DataFrame]], dict[str, DataFrame]]] = {1: _from_1}


def migrate(spark: SparkSession, root: str) -> list[int]:
    """Bring a stored catalogue to today's schema, a step for each version, under one manifest; returns the steps taken.

    A step that refuses leaves the catalogue as it was, and so does a version of a later release.
    """
    found = _manifest(spark, root)
    todo = list(range(found.schema, SCHEMA_VERSION))
    if found.schema > SCHEMA_VERSION or any(v not in STEPS for v in todo):
        _checked(found)
    if not todo:
        return []
    tables = {name: _opened(spark, root, found, name) for name in found.tables}
    changed: dict[str, DataFrame] = {}
    for version in todo:
        changed |= STEPS[version](tables | changed, lambda name: spark.createDataFrame([], TABLES[name]))
    _commit(spark, root, found, {table: [_written(df, root, table)] for table, df in changed.items()})
    return todo


def create_schema(spark: SparkSession, root: str) -> None:
    """Tables of every schema: those that are there stay, with null in columns they lack; others are made empty. An older catalogue is migrated."""
    migrate(spark, root)
    known = _manifest(spark, root).tables
    made = {}
    for name, ddl in TABLES.items():
        empty = spark.createDataFrame([], ddl)
        if name not in known:
            made[name] = empty
        elif current(spark, root, name).columns != empty.columns:
            made[name] = empty.unionByName(current(spark, root, name), allowMissingColumns=True).select(*empty.columns)
    if made:
        publish_all(spark, root, made)


def export_snapshot(spark: SparkSession, root: str, target: str) -> dict[str, int]:
    """Copy a catalogue without people's activity; returns the rows of each table written."""
    if root.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target is the source")
    publish_all(spark, target, {name: spark.createDataFrame([], ddl) if name in ACTIVITY else current(spark, root, name) for name, ddl in TABLES.items()})
    return {name: current(spark, target, name).count() for name in TABLES}
