"""A written inverted index of segments: built once, opened by many searches, grown by adding documents.

Each segment holds postings (slot, term, doc_id, tf, dl) sorted by term within slots of a term's hash, document
frequencies by term, the vocabulary and the documents' lengths. Nothing in a segment depends on the others: a query adds
up the frequencies of its own terms and the collection's size from the segments' counts, so scores are those of one
index over all documents. Numbered manifests name the segments; only complete ones are read. Adding documents writes a
segment and merges it with those before it that are no larger, so there are few segments and a posting is written a
logarithmic number of times.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stemmed, tokens
from ..scratch import forget, staged
from .index import B, K1, SLOT_ROWS, slot_of, spread, tallied

POSTINGS = "term string, doc_id long, tf long, dl int, segment string, slot int"


@dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    words: int
    postings: int
    slots: int


def slot_number(term: str, slots: int) -> int:
    """``index.slot_of`` of one term on the driver."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % slots


def counted(words: Column) -> Column:
    """Array of (term, tf) of a document's words."""
    return tallied(stemmed(words))


class StoredIndex:
    """The segments of the newest manifest under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.number, self.segments = _read(spark, path)
        if not self.number:
            raise ValueError(f"{path} has no index")

    @classmethod
    def create(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> StoredIndex:
        """A new index over docs in place of whatever is there."""
        spark = docs.sparkSession
        number, _ = _read(spark, path)
        _commit(spark, path, number, [_segment(docs, path, id_col, text_col, slots)])
        return cls(spark, path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> StoredIndex:
        """The index with further documents. Ids that it has, or that come twice, are an error and change nothing."""
        fresh = docs.select(F.col(id_col).cast("long").alias("doc_id"))
        twice = fresh.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        known = twice.unionByName(fresh.join(self.lengths().select("doc_id"), "doc_id", "left_semi")).limit(5).collect()
        if known:
            raise ValueError(f"ids that are indexed already or come twice, such as {', '.join(str(r[0]) for r in known)}")
        kept, slots = list(self.segments), self.segments[0].slots
        new = _segment(docs, self.path, id_col, text_col, slots)
        merged = [new]
        while kept and kept[-1].postings <= sum(s.postings for s in merged):
            merged.insert(0, kept.pop())
        if len(merged) > 1:
            # the slots of a whole index follow its size; parts share those of the others
            total = sum(s.postings for s in merged)
            new = _write(self._rows(merged), self._parts("docs", merged).select("doc_id", "dl"), self._summed(merged), self.path, slots if kept else max(slots, -(-total // SLOT_ROWS)))
        _commit(self.spark, self.path, self.number, [*kept, new])
        return StoredIndex(self.spark, self.path)

    def _parts(self, table: str, segments: Iterable[Segment] | None = None, schema: str | None = None) -> DataFrame:
        base = f"{self.path}/{table}"
        reader = self.spark.read.option("basePath", base)
        return (reader.schema(schema) if schema else reader).parquet(*[f"{base}/segment={s.name}" for s in segments or self.segments])

    def _rows(self, segments: Iterable[Segment]) -> DataFrame:
        return self._parts("postings", segments, POSTINGS).select("term", "doc_id", "tf", "dl")

    def _summed(self, segments: Iterable[Segment]) -> DataFrame:
        return self._parts("vocabulary", segments, "word string, doc_freq long, segment string").groupBy("word").agg(F.sum("doc_freq").alias("doc_freq"))

    def __len__(self) -> int:
        return sum(s.docs for s in self.segments)

    def average(self) -> float:
        """Mean number of words of a document."""
        return sum(s.words for s in self.segments) / max(1, len(self))

    def lengths(self) -> DataFrame:
        """(doc_id, dl) of every document, those without words included."""
        return self._parts("docs", schema="doc_id long, dl int, segment string").select("doc_id", "dl")

    def vocabulary(self) -> DataFrame:
        """(word, doc_freq) of unstemmed words."""
        one = self._parts("vocabulary", schema="word string, doc_freq long, segment string").select("word", "doc_freq")
        return one if len(self.segments) == 1 else self._summed(self.segments)

    def postings(self) -> DataFrame:
        """(term, doc_id, tf, dl, segment, slot), on which filters of slot and term prune files and row groups."""
        return self._parts("postings", schema=POSTINGS)

    def of_terms(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of a table with (term, slot) for the given terms: partitions and row groups of others stay unread."""
        slots = self.segments[0].slots
        return table.where(F.col("slot").isin(sorted({slot_number(t, slots) for t in terms})) & F.col("term").isin(sorted(terms)))

    def frequencies(self) -> DataFrame:
        """(term, df, segment, slot); a term's document frequency is the sum over the segments."""
        return self._parts("frequencies", schema="term string, df long, segment string, slot int")

    def idf(self, terms: list[str]) -> dict[str, float]:
        """Inverse document frequencies of a query's terms; those that no document has are absent."""
        rows = self.of_terms(self.frequencies(), terms).groupBy("term").agg(F.sum("df").alias("df")).collect() if terms else []
        return {r["term"]: math.log(1 + (len(self) - r["df"] + 0.5) / (r["df"] + 0.5)) for r in rows}

    def weight(self, idf: Column, k1: float = K1, b: float = B) -> Column:
        """BM25 of a posting's term."""
        return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (self.average() or 1.0)))

    def scores(self, terms: list[str]) -> DataFrame:
        """(doc_id, score) of one query's terms, by one scan of their slots and a sum."""
        idf = self.idf(list(dict.fromkeys(terms)))
        found = self.of_terms(self.postings(), sorted(idf)) if idf else self.postings().where(F.lit(False))
        each = F.coalesce(*[F.when(F.col("term") == t, F.lit(x)) for t, x in idf.items()], F.lit(0.0))
        return found.groupBy("doc_id").agg(F.sum(self.weight(each)).alias("score"))

    def weights(self) -> DataFrame:
        """(term, doc_id, weight, slot) of all postings, for batches of queries by ``rank.bm25``; a table of the terms'
        frequencies is joined to what the query leaves of the postings."""
        slots = self.segments[0].slots
        df = self.frequencies().groupBy("slot", "term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (len(self) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return self.postings().join(df, ["slot", "term"]).select("term", "doc_id", self.weight(idf).alias("weight"), "slot").withMetadata("slot", {"slots": slots})


def _segment(docs: DataFrame, path: str, id_col: str, text_col: str, slots: int | None) -> Segment:
    texts = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")))
    words = staged(texts.select("doc_id", tokens(F.col("_text"), stem=False).alias("words")).withColumn("dl", F.size("words")), "words")
    vocab = words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("doc_freq"))
    rows = words.select("doc_id", "dl", F.explode(counted(F.col("words"))).alias("p")).select("p.term", "doc_id", "p.tf", "dl")
    made = _write(rows, words.select("doc_id", "dl"), vocab, path, slots)
    forget(words)
    return made


def _write(rows: DataFrame, lengths: DataFrame, vocab: DataFrame, path: str, slots: int | None) -> Segment:
    """Write a segment's tables. Rows of a slot stay together unless they are too many, and are sorted by term."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    lengths.write.parquet(f"{path}/docs/segment={name}")
    size = spark.read.parquet(f"{path}/docs/segment={name}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    # a document has about as many postings as it has different words; the words bound them
    n = slots or max(8, -(-size["words"] // SLOT_ROWS))
    vocab.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/vocabulary/segment={name}")
    slotted = rows.withColumn("slot", slot_of(F.col("term"), n)).select("term", "doc_id", "tf", "dl", "slot")
    slotted.hint("rebalance", "slot").sortWithinPartitions("slot", "term").write.partitionBy("slot").parquet(f"{path}/postings/segment={name}")
    stored = spark.read.schema("term string, slot int").parquet(f"{path}/postings/segment={name}") if size["words"] else rows.select("term", F.lit(0).alias("slot"))
    seen = stored.groupBy("slot", "term").agg(F.count("*").alias("df"))
    seen.repartition("slot").sortWithinPartitions("slot", "term").write.partitionBy("slot").parquet(f"{path}/frequencies/segment={name}")
    return Segment(name, size["n"], size["words"], stored.count(), n)


def _read(spark: SparkSession, path: str) -> tuple[int, list[Segment]]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_segments/*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    numbers = [int(f.getPath().getParent().getName()) for f in found]
    if not numbers:
        return 0, []
    rows = spark.read.parquet(f"{path}/_segments/{max(numbers):012d}").orderBy("place").collect()  # a row for each segment
    return max(numbers), [Segment(r["name"], r["docs"], r["words"], r["postings"], r["slots"]) for r in rows]


def _commit(spark: SparkSession, path: str, number: int, segments: list[Segment]) -> None:
    rows = [(k, *asdict(s).values()) for k, s in enumerate(segments)]
    spark.createDataFrame(rows, "place int, name string, docs long, words long, postings long, slots int").coalesce(1).write.mode("error").parquet(f"{path}/_segments/{number + 1:012d}")
