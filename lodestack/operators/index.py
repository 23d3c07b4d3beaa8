"""Inverted index: postings, collection statistics, vocabulary, precomputed BM25 weights.

Everything is keyed by term or document and built by partial aggregation, so it scales with the postings. ``explode_outer``
keeps the optimizer from evaluating the tokenizer twice for its size filter.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stemmed, tokens
from ..scratch import staged

K1, B = 1.5, 0.75


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where a small file would keep the tokenizer on a few; larger tables stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toks, dl)."""
    toks = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).select("doc_id", tokens(F.col("_text")).alias("toks"))
    return toks.withColumn("dl", F.size("toks"))


def postings_of(toks: DataFrame) -> DataFrame:
    """(term, doc_id, dl, tf) from tokenized()."""
    each = toks.withColumn("term", F.explode_outer("toks")).where(F.col("term").isNotNull())
    return each.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def stats_of(toks: DataFrame) -> DataFrame:
    """One row (n_docs, avg_dl) from tokenized()."""
    return toks.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, dl, tf). Documents without tokens have no posting but count in the statistics.

    A document's terms are counted where the document lies: rows of one document need no shuffle.
    """
    return postings_of(tokenized(docs, id_col, text_col))


def tallied(terms: Column) -> Column:
    """Array of (term, tf) of a document's terms: they are sorted and cut into runs, so no shuffle counts them."""
    runs = F.transform(F.array(F.array_sort(terms)), lambda s: F.struct(s.alias("s"), F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))).alias("at")))
    made = F.transform(runs, lambda r: F.transform(r["at"], lambda i, k: F.struct(F.get(r["s"], i).alias("term"), (F.coalesce(F.get(r["at"], k + 1), F.size(r["s"])) - i).cast("long").alias("tf"))))
    return F.when(F.size(terms) > 0, F.get(made, F.lit(0))).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


#: Query terms up to this number are looked up while a document is read; beyond it all its terms are kept.
LOOKED_UP = 20_000


def read_for(docs: DataFrame, terms: Collection[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, has: array of (term, tf)), staged: one reading of the texts for searches with known terms. Every
    document has a row, so that the statistics of the collection come from it too."""
    toks = tokenized(docs, id_col, text_col)
    wanted = toks.withColumn("toks", F.filter("toks", lambda t: t.isin(sorted(terms)))) if len(terms) <= LOOKED_UP else toks
    return staged(wanted.select("doc_id", "dl", tallied(F.col("toks")).alias("has")), "read")


def duplicate_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that occur more than once; an index over them would be an error."""
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (n_docs, avg_dl) over all documents, empty ones included; avg_dl is 0 for an empty collection."""
    return stats_of(tokenized(docs, id_col, text_col))


def doc_freq(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def weights(post: DataFrame, collection: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(term, doc_id, weight): BM25 of one occurrence in a query, idf and length norm folded in.

    idf uses the whole collection, so a filter applied later never changes a score.
    """
    # the statistics are one row
    return post.join(doc_freq(post), "term").join(F.broadcast(collection)).select("term", "doc_id", weight(k1, b).alias("weight"))


def weight(k1: float = K1, b: float = B) -> Column:
    """BM25 of one occurrence in a query, from n_docs, avg_dl, df, tf and dl."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative and b must lie in 0..1")
    n, avg = F.col("n_docs"), F.when(F.col("avg_dl") > 0, F.col("avg_dl")).otherwise(1.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg)))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, doc_freq) of unstemmed words."""
    words = spread(docs.select(F.col(text_col).alias("_text"))).select(F.explode_outer(F.array_distinct(tokens(F.col("_text"), stem=False))).alias("word")).where(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count("*").alias("doc_freq"))


#: Rows of weights that one slot should hold.
SLOT_ROWS = 2_000_000


def slot_of(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def write_index(docs: DataFrame, path: str, slots: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Persist statistics, vocabulary, and weights partitioned by a hash of the term, so that a query's terms prune files.

    Texts are cut into words once; all tables come from that. The number of slots follows from the number of postings
    and is kept with the statistics. Rows of a slot stay together unless they are too many.
    """
    spark = docs.sparkSession
    words = staged(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).select("doc_id", tokens(F.col("_text"), stem=False).alias("words")), "words")
    vocab = words.select(F.explode_outer(F.array_distinct("words")).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("doc_freq"))
    vocab.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/vocabulary")
    terms = words.select("doc_id", F.size("words").alias("dl"), F.explode_outer(stemmed(F.col("words"))).alias("term")).where("term is not null")
    post = staged(terms.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")), "postings")
    n = slots or max(8, -(-post.count() // SLOT_ROWS))
    found = words.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("avg_dl"))
    found.withColumn("slots", F.lit(n)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    made = weights(post, spark.read.parquet(f"{path}/stats")).withColumn("slot", slot_of(F.col("term"), n))
    made.hint("rebalance", "slot").sortWithinPartitions("slot", "term").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/weights")


def open_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, weight, slot) of a written index, with which ``rank.bm25`` opens only the slots of a query's terms."""
    n = spark.read.parquet(f"{path}/stats").first()["slots"]
    schema = "term string, doc_id long, weight double, slot int"
    return spark.read.schema(schema).parquet(f"{path}/weights").withMetadata("slot", {"slots": n})
