"""Labelled documents for fitting a classifier: all of them, dealt into parts, or a bounded sample on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, members_of, sieve, staged

#: Labelled documents that a classifier is fitted on at most; every document is scored.
SAMPLE = 4000
#: Characters that their texts hold together at most (the first of them counts whatever its length).
SAMPLE_CHARS = 64_000_000


#: Labelled documents, and characters of their texts, that a part holds about; a task fits on a part at a time.
PART, PART_CHARS = 4000, 32_000_000


def dealt(docs: DataFrame, labels: DataFrame, label: str, modulus: int, kept_out: int) -> tuple[DataFrame, int]:
    """All labelled rows (part, doc_id, text, lang, y) whose crc32(doc_id as text) mod ``modulus`` is not ``kept_out``,
    staged, and the number of parts. Ids, labels and texts count as in ``sample``; parts are hashes of the ids.
    """
    key = F.col("doc_id").cast("long")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != kept_out)
    y = known.groupBy(key.alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang")).where("doc_id is not null")
    # the lengths alone are joined for the number of parts, and the sieve keeps other texts out of the shuffle
    size = rows.select("doc_id", F.length("text").alias("chars")).join(y, "doc_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // PART), -(-size["chars"] // PART_CHARS))
    sent = docs.sparkSession.sparkContext.broadcast(sieve(y.select((F.col("doc_id") * 2).alias("node")), "node"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(members_of(sent.value, batch.column("doc_id").to_numpy() * 2)))

    found = by_batch(rows, likely, "doc_id long, text string, lang string").join(y, "doc_id")
    found = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"), F.min("y").alias("y"))
    rows = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "r.text", "r.lang", "y")
    return staged(rows.repartition(parts, "part").sortWithinPartitions("part", "doc_id"), "labelled"), parts


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, kept_out: int, limit: int = SAMPLE) -> list[tuple[int, str, str | None, int]]:
    """Up to ``limit`` (doc_id, text, lang, label) whose crc32(doc_id as text) mod ``modulus`` is not ``kept_out``.

    Which rows: those with the smallest hash of doc_id, as far as SAMPLE_CHARS go. Null ids and labels are left out,
    null text is empty. A doc_id that is labelled or stored more than once is used once, with its smallest label, and
    its smallest text and language; the choice is made before anything comes to the driver.
    """
    key = F.col("doc_id").cast("long")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != kept_out)
    rows = known.groupBy(key.alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    if not rows:
        return []
    y = {r["doc_id"]: r["y"] for r in rows}

    def stored(ids: list[int]) -> DataFrame:
        """One row for each of the ids, at most ``limit``."""
        picked = docs.sparkSession.createDataFrame([(k,) for k in ids], "picked long")
        lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
        row = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
        found = docs.join(F.broadcast(picked), key == F.col("picked"), "left_semi").select(key.alias("doc_id"), row.alias("r"))
        return found.groupBy("doc_id").agg(F.min("r").alias("r"))

    chars = {r["doc_id"]: r["n"] for r in stored(list(y)).select("doc_id", F.length("r.text").alias("n")).collect()}
    ids, total = [], 0
    for k in y:  # in the order of the hashes
        if k in chars:
            if ids and total + chars[k] > SAMPLE_CHARS:
                break
            ids.append(k)
            total += chars[k]
    if not ids:
        return []
    texts = {r["doc_id"]: r["r"] for r in stored(ids).collect()}
    return [(k, texts[k]["text"], texts[k]["lang"] or None, y[k]) for k in sorted(texts)]
