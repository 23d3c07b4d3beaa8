"""Written indexes of segments, and catalogues over them, against the lazy ones."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions.text import tokenize
from lodestack.operators import index, rank
from lodestack.operators.catalog import Catalog
from lodestack.operators.facets import Filters
from lodestack.operators.stored import StoredIndex, counted, slot_number

WORDS = "graph graphs tree trees heap sort sorting lecture notes quiz midsem solutions of and the 2021 algebra calculus series limits".split()


def documents(n, seed=0):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30)))) for k in range(n)]


def rounded(df):
    return sorted((r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_terms_of_a_document_are_counted_in_place(spark):
    df = spark.createDataFrame([(1, "b a b trees tree a b".split()), (2, [])], "doc_id long, w array<string>")
    got = {r["doc_id"]: [(x["term"], x["tf"]) for x in r["c"]] for r in df.select("doc_id", counted(F.col("w")).alias("c")).collect()}
    assert got == {1: [("a", 2), ("b", 3), ("tree", 2)], 2: []}
    terms = ["tree", "é", "", "x" * 50]
    hashed = spark.createDataFrame([(t,) for t in terms], "t string").select("t", index.slot_of(F.col("t"), 13).alias("s")).collect()
    assert all(slot_number(r["t"], 13) == r["s"] for r in hashed)


def test_segments_score_as_one_index(spark, tmp_path):
    rows = documents(260)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toks = index.tokenized(docs, "doc_id", "text")
    whole = index.weights(index.postings_of(toks), index.stats_of(toks))
    path = str(tmp_path / "i")
    stored = StoredIndex.create(docs.where("doc_id < 100"), path, slots=5)
    for low, high in ((100, 110), (110, 118), (118, 200), (200, 260)):
        stored = stored.add(docs.where(f"doc_id between {low} and {high - 1}"))
    assert len(stored) == 260 and 1 < len(stored.segments) < 4 and stored.lengths().count() == 260
    for query in ("trees and heaps", "midsem 2021 solutions", "nothing known here", ""):
        terms = list(dict.fromkeys(tokenize(query)))
        want = whole.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.sum("weight").alias("score"))
        assert rounded(stored.scores(terms)) == rounded(want), query
    batch = rank.query_terms(spark.createDataFrame([(1, "trees heap"), (2, "algebra")], "q long, t string"), "q", "t")
    sums = lambda w: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in rank.bm25(w, batch).collect())
    assert sums(stored.weights()) == sums(whole)
    words = lambda df: sorted(map(tuple, df.collect()))
    assert words(stored.vocabulary()) == words(index.vocabulary(docs))
    for bad in ([(5, "again")], [(900, "a"), (900, "b")]):
        with pytest.raises(ValueError, match="ids that are indexed"):
            stored.add(spark.createDataFrame(bad, "doc_id long, text string"))
    assert len(StoredIndex(spark, path)) == 260
    plan = stored.scores(["tree", "heap"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term, [" in plan


def test_a_written_catalogue_finds_what_a_lazy_one_finds(spark, tmp_path):
    rng = random.Random(3)
    schema = "doc_id long, path string, name string, course_code string, course_name string, doc_type string, exam_type string, academic_year int, searchable_extra string"
    rows = [(k, f"/CS/{rng.choice(WORDS)}", " ".join(rng.choices(WORDS, k=4)), rng.choice(["CS1", "MA1"]), "Course", rng.choice(["pyq", "notes"]), "quiz", 2020 + k % 4, "") for k in range(120)]
    view = spark.createDataFrame(rows, schema)
    texts = spark.createDataFrame(documents(90, 5), "doc_id long, text string")
    aliases = spark.createDataFrame([("maths", "MA1")], "alias string, code string")
    path = str(tmp_path / "c")
    Catalog.write(view.where("doc_id < 80"), path, aliases, texts.where("doc_id < 80"))
    opened = Catalog.add(spark, path, view.where("doc_id >= 80"), texts.where("doc_id >= 80"))
    lazy = Catalog(view, aliases, texts)
    shown = lambda df: [(r["doc_id"], round(r["score"], 6), tuple(r["matched_terms"])) for r in df.collect()]
    for query, filters in (("maths trees quiz", None), ("heap 2021", Filters(doc_type=frozenset({"pyq"}))), ("", Filters(course=frozenset({"CS1"})))):
        a, b = opened.search(query, filters), lazy.search(query, filters)
        assert shown(a.hits) == shown(b.hits) and a.total() == b.total() and a.detected == b.detected
        assert sorted(map(str, a.facets.collect())) == sorted(map(str, b.facets.collect()))
    for got, want in zip(opened.search_content("algebra series"), lazy.search_content("algebra series")):
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect())
    assert [tuple(r) for r in opened.suggest("s").collect()] == [tuple(r) for r in lazy.suggest("s").collect()] and len(opened) == 120
    plan = opened.search("trees").hits._jdf.queryExecution().executedPlan().toString()
    assert any("slot#" in x.split("PushedFilters")[0] for x in plan.split("PartitionFilters")[1:])
    with pytest.raises(ValueError):
        Catalog.add(spark, path, view.where("doc_id = 3"))
    empty = Catalog.write(view.limit(0), str(tmp_path / "none"))
    assert empty.search("trees").total() == 0 and not empty.has_content()
