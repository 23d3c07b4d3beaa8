"""Search strategies behind one protocol: a query text to (doc_id, score, rank)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from . import index, rank


class SearchStrategy(Protocol):
    def search(self, query: str, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
        """The best documents of a query, best first; allowed (doc_id) restricts them. A query without words has none."""


def _terms(docs: DataFrame, query: str) -> DataFrame:
    return rank.query_terms(docs.sparkSession.createDataFrame([(0, query)], "query_id long, text string"), "query_id", "text")


def _best(scores: DataFrame, limit: int) -> DataFrame:
    return rank.top_k(scores, limit).select("doc_id", "score", "rank").orderBy("rank")


class NaiveSearch:
    """By the number of different query words that a document has."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.postings = index.postings(docs, id_col, text_col)

    def search(self, query: str, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
        scores = rank.naive(self.postings, _terms(self.postings, query))
        return _best(scores if allowed is None else scores.join(allowed.select("doc_id"), "doc_id", "left_semi"), limit)


class Bm25Search:
    """By BM25 with the given constants, over documents or a written index."""

    def __init__(self, docs: DataFrame, k1: float = index.K1, b: float = index.B, id_col: str = "doc_id", text_col: str = "text"):
        toks = index.tokenized(docs, id_col, text_col)
        self.weights = index.weights(index.postings_of(toks), index.stats_of(toks), k1, b)

    @classmethod
    def of_index(cls, spark, path: str) -> Bm25Search:
        out = cls.__new__(cls)
        out.weights = index.open_weights(spark, path)
        return out

    def search(self, query: str, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
        return _best(rank.bm25(self.weights, _terms(self.weights, query), allowed), limit)
