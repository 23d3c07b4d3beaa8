"""Ranking: BM25 and naive scores in batches of queries, top-k, prefix suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..scratch import staged
from . import index
from .index import slot_of

#: Query terms up to this number are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 200_000


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term), each term once."""
    terms = queries.select(F.col(id_col).alias("query_id"), F.explode_outer(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return terms.where(F.col("term").isNotNull())


#: Terms up to this number are also a filter on the scan.
FILTER_TERMS = 1000


def counted_terms(terms: DataFrame) -> list | None:
    """The rows of the query terms if they are few enough to be broadcast, else None."""
    rows = terms.limit(BROADCAST_TERMS + 1).collect()
    return rows if len(rows) <= BROADCAST_TERMS else None


def matching(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows (term, ...) of the query terms, with their query_id. Few terms become literal rows, which are cut and counted
    once and broadcast; of a written index (it has ``slot``) only the terms' partitions are read."""
    slots = rows.schema["slot"].metadata["slots"] if "slot" in rows.columns else None
    if slots:
        terms = terms.withColumn("slot", slot_of(F.col("term"), slots))
    keys = ["slot", "term"] if slots else ["term"]
    known = counted_terms(terms)
    if known is None:
        return rows.join(terms, keys)
    words = {r["term"] for r in known}
    if slots:
        rows = rows.where(F.col("slot").isin(sorted({r["slot"] for r in known})))
    if len(words) <= FILTER_TERMS:
        rows = rows.where(F.col("term").isin(sorted(words)))
    return rows.join(F.broadcast(terms.sparkSession.createDataFrame(known, terms.schema)), keys)


def bm25(weights: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score). ``allowed`` (doc_id) restricts the output, never the statistics."""
    hits = matching(weights, terms)
    if allowed is not None:
        hits = hits.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return hits.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def bm25_of_texts(docs: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bm25`` over documents that have no index: their texts are read once, for the terms of the queries alone."""
    known = counted_terms(terms)
    if known is None:
        toks = staged(index.tokenized(docs, id_col, text_col), "toks")
        return bm25(index.weights(index.postings_of(toks), index.stats_of(toks)), terms, allowed)
    read = index.read_for(docs, {r["term"] for r in known}, id_col, text_col)
    return bm25_of_read(read, terms.sparkSession.createDataFrame(known, terms.schema), allowed)


def bm25_of_read(read: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``bm25`` over ``index.read_for`` of the terms, of which there are at most BROADCAST_TERMS.

    A document's rows are dealt to one task before they meet the queries, so that no pair of a query and a document is
    shuffled.
    """
    each = lambda of: of.select("doc_id", "dl", F.explode("has").alias("h")).select("doc_id", "dl", "h.term", "h.tf")
    # rows of one id and length make one posting, as in ``postings_of``
    twice = not index.duplicate_ids(read).isEmpty()
    df = index.doc_freq(each(read).dropDuplicates(["term", "doc_id", "dl"]) if twice else each(read))
    collection = read.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))
    asked = staged(terms.join(df, "term").join(F.broadcast(collection)), "asked")
    found = each((read if allowed is None else read.join(allowed.select("doc_id"), "doc_id", "left_semi")).repartition("doc_id"))
    if twice:
        found = found.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))
    hits = found.join(F.broadcast(asked), "term").select("query_id", "doc_id", index.weight().alias("weight"))
    return hits.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def naive(post: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): number of distinct query terms that the document has."""
    return matching(post.select("term", "doc_id"), terms).groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def ranked(scores: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Scores with a 1-based rank by (score, then smaller id); scores that agree to six places tie."""
    own = order or [F.round("score", 6).desc(), F.col("doc_id")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*own)))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The best k of each query; none for k <= 0."""
    return ranked(scores).where(F.col("rank") <= max(k, 0))


def complete(vocab: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Words that begin with the prefix (stripped, case-folded, not tokenised), most frequent first; none for a blank one."""
    p = prefix.strip().casefold()
    found = vocab.where(F.col("word").startswith(p)) if p else vocab.where(F.lit(False))
    return found.orderBy(F.desc("doc_freq"), "word").limit(limit)


def merge_vocabulary(*parts: DataFrame) -> DataFrame:
    """Words inserted again add their weight; the empty word is refused."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where("word <> ''").groupBy("word").agg(F.sum("doc_freq").alias("doc_freq"))


def first_relevant(ranks: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, rank): the best rank within k of a relevant (query_id, doc_id); queries without one are absent."""
    return ranks.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))


def rank_stats(ranks: DataFrame, k: int) -> DataFrame:
    """One row (n, hit_at_1, hit_at_k, mrr) over (rank); a null rank is a miss."""
    hit = lambda n: F.count_if(F.col("rank") <= n)
    return ranks.agg(F.count("*").alias("n"), hit(1).alias("hit_at_1"), hit(k).alias("hit_at_k"), F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
