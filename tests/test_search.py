"""Index, ranking, facets, stacks, catalogue and planner on a small collection."""

import math

import pytest
from pyspark.sql import functions as F

from lodestack.operators import facets, index, measure, rank, stacks
from lodestack.operators.catalog import Catalog, course_scan, unnamed
from lodestack.plans.chat import Form
from lodestack.plans.engine import Engine
from lodestack.plans.planner import Planner

DOCS = [(0, "apple banana apple"), (1, "banana cherry"), (2, "cherry cherry date fig"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    post = index.postings(docs)
    return docs, post, index.weights(post, index.stats(docs))


def test_statistics(built):
    docs, post, _ = built
    s = index.stats(docs).first()
    assert (s["n_docs"], s["avg_dl"]) == (5, 9 / 5)
    assert {(r["term"], r["df"]) for r in index.doc_freq(post).collect()} == {("apple", 1), ("banana", 2), ("cherry", 2), ("date", 1), ("fig", 1)}
    assert index.stats(docs.limit(0)).first()["avg_dl"] == 0.0


def test_bm25_by_hand(spark, built):
    docs, _, weights = built
    q = spark.createDataFrame([(1, "apple apple banana"), (2, "the of"), (3, None)], "q long, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in rank.bm25(weights, rank.query_terms(q, "q", "text")).collect()}
    idf = lambda n: math.log(1 + (5 - n + 0.5) / (n + 0.5))
    tf = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / 1.8))
    assert got == {(1, 0): pytest.approx(idf(1) * tf(2, 3) + idf(2) * tf(1, 3)), (1, 1): pytest.approx(idf(2) * tf(1, 2))}
    with pytest.raises(ValueError):
        index.weights(built[1], index.stats(docs), b=1.5)


def test_filters_do_not_change_scores(spark, built):
    _, _, weights = built
    terms = rank.query_terms(spark.createDataFrame([(1, "banana")], "q long, text string"), "q", "text")
    every = {r["doc_id"]: r["score"] for r in rank.bm25(weights, terms).collect()}
    some = rank.bm25(weights, terms, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert [(r["doc_id"], r["score"]) for r in some] == [(1, every[1])]


def test_top_k_ties_by_id(spark):
    scores = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, 2.0)], "query_id long, doc_id long, score double")
    assert [r["doc_id"] for r in sorted(rank.top_k(scores, 2).collect(), key=lambda r: r["rank"])] == [4, 3]
    assert rank.top_k(scores, 0).count() == 0


def test_rank_stats_and_completion(spark):
    ranks = spark.createDataFrame([(1,), (2,), (None,), (9,)], "rank int")
    assert rank.rank_stats(ranks, 5).first().asDict() == {"n": 4, "hit_at_1": 1, "hit_at_k": 2, "mrr": 0.375}
    vocab = spark.createDataFrame([("ape", 2), ("apple", 5), ("apply", 5), ("b", 9)], "word string, doc_freq long")
    assert [r["word"] for r in rank.complete(vocab, " AP", 2).collect()] == ["apple", "apply"]
    assert rank.complete(vocab, "  ").count() == 0


def view_rows():
    kinds = [("pyq", "midsem", 2021), ("pyq", "midsem", 2022), ("solution", "midsem", 2022), ("slides", "none", None), ("notes", "none", 2020), ("pyq", "quiz", 2022), ("pyq", "unknown", 2020), ("slides", "none", 2022)]
    rows = []
    for k, (kind, exam, year) in enumerate(kinds):
        for c, course in enumerate(("CS1", "MA2")):
            i = 2 * k + c
            rows.append((i, f"f{i}", f"/{course}/x", f"{kind} graphs {k}" if k % 2 else f"{kind} trees {k}", "https://x", kind, exam, k % 3 or None, year, False, kind == "solution", 0.9, "rule", course, {"CS1": "Computing", "MA2": ""}[course], 1, "P", "post_midsem" if k == 7 else None))
    return rows


@pytest.fixture(scope="module")
def catalog(spark):
    from lodestack.schemas import DOCUMENT_VIEW

    view = spark.createDataFrame(view_rows(), "doc_id long, " + DOCUMENT_VIEW)
    aliases = spark.createDataFrame([("comp basics", "CS1"), ("gone", "XX9")], "alias string, code string")
    texts = spark.createDataFrame([(0, "binary search trees"), (2, "hash tables"), (4, "trees again"), (6, "")], "doc_id long, text string")
    return Catalog(view, aliases, texts)


def test_course_names(spark, catalog):
    assert catalog.aliases == {"compbasics": "CS1", "cs1": "CS1", "ma2": "MA2", "computing": "CS1"}
    assert catalog.interpret("notes, comp basics! and MA2") == (["CS1", "MA2"], "notes and")
    df = spark.createDataFrame([("notes, comp basics! and MA2",), ("",), ("cs1 cs1",)], "t string")
    al = F.create_map(*[F.lit(x) for kv in catalog.aliases.items() for x in kv])
    got = [(r["s"], r["rest"]) for r in df.select(course_scan(F.col("t"), al).alias("s")).withColumn("rest", unnamed(F.col("s.marked"))).collect()]
    assert [(g["codes"], g["marked"], rest) for g, rest in got] == [(["CS1", "MA2"], "notes,  | ! and  | ", "notes and"), ([], "", ""), (["CS1"], " |   | ", "")]


def test_search_modes(catalog):
    nothing = catalog.search("")
    assert nothing.total() == 0 and nothing.facets.count() > 0
    browse = catalog.search("", facets.Filters(course=frozenset({"CS1"})))
    years = [r["academic_year"] for r in browse.hits.collect()]
    assert years == sorted(years, key=lambda y: -(y or 0)) and browse.total() == 8
    detected = catalog.search("comp basics graphs")
    assert detected.detected == ["CS1"] and {r["course_code"] for r in detected.hits.collect()} == {"CS1"}
    assert catalog.search("graphs", max_hits=3).hits.count() == 3 and catalog.search("graphs").total() == 8
    assert {tuple(r["matched_terms"]) for r in catalog.search("tree graphs").hits.collect()} == {("tree",), ("graphs",)}


def test_facets_ignore_their_own_filter(catalog):
    f = facets.Filters(course=frozenset({"CS1"}), doc_type=frozenset({"pyq"}))
    got = {(r["facet"], r["value"]): r["n"] for r in catalog.search("", f).facets.collect()}
    assert got["course", "MA2"] == 4 and got["doc_type", "slides"] == 2 and got["exam_type", "midsem"] == 2
    assert ("exam_type", "unknown") not in got and ("year", "2099") not in got
    assert catalog.search("", facets.Filters(exam_type=frozenset({"none"}))).total() == 0
    with pytest.raises(ValueError):
        f.without("colour")
    with pytest.raises(ValueError):
        facets.parse_years(["1999"])


def test_stacks(catalog):
    hits = catalog.search("", facets.Filters(course=frozenset({"CS1"}))).hits
    got = stacks.stacks(hits).orderBy("place").collect()
    assert got[0]["title"] == "Computing · Exam papers" and got[0]["kind"] == "papers"
    mid = next(r for r in got if r["exam"] == "midsem")
    assert (mid["size"], mid["years"], mid["year_span"], mid["solution_count"]) == (3, [2021, 2022], "2021-22 to 2022-23", 1)
    paged = stacks.page(stacks.stacks(hits), 0, 2).collect()
    assert len(paged) == 2 and paged[0]["has_more"]
    assert stacks.stacks(hits.limit(0)).count() == 0


def test_content_search(catalog):
    matched, unreadable, readable = catalog.search_content("trees", facets.Filters(course=frozenset({"CS1"})))
    assert {r["doc_id"] for r in matched.collect()} == {0, 4} and readable.count() == 3
    assert {r["doc_id"] for r in unreadable.collect()} == {6, 8, 10, 12, 14}


def test_planner(catalog):
    plan = Planner(catalog).run(Form(courses=("CS1",), exam_types=("midsem",), materials=("papers", "solutions"), topics=("trees",)))
    got = {r["doc_id"]: r["source"] for r in plan.hits.collect()}
    assert got == {0: "content", 4: "content"}
    dropped = Planner(catalog).run(Form(courses=("CS1",), exam_types=("midsem",), materials=("slides",)))
    assert {r["doc_id"] for r in dropped.hits.collect()} == {6}
    latest = Planner(catalog).run(Form(courses=("CS1",), exam_types=("quiz",), materials=("papers",), recent_years=1))
    assert latest.paper_years == [2022] and {r["doc_id"] for r in latest.hits.collect()} == {10}


def test_engine(catalog):
    e = Engine(catalog, resolve_course=lambda m: ["CS1", "??"])
    assert e.reply("hello!")[0] == "smalltalk" and e.reply("   ")[0] == "unclear"
    kind, read, n = e.reply("midsem papers")
    assert (kind, read.form.courses) == ("confirm", ("CS1",)) and n == 2
    assert e.cards(e.search("graphs")).count() == 8 and e.page(e.search("graphs")).count() > 0
    with pytest.raises(ValueError):
        e.search("x" * 201)


def test_written_index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index.write_index(docs, str(tmp_path / "i"), slots=4)
    back = spark.read.parquet(str(tmp_path / "i/weights"))
    assert back.count() == 7 and spark.read.parquet(str(tmp_path / "i/vocabulary")).count() == 5


def test_measurement(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3] if k < 9 else "a", k / 20, "p", f"n{k}") for k in range(20)], "doc_id long, doc_type string, confidence double, path string, name string")
    sample = measure.balanced_sample(rows, "doc_type", "doc_id", 7).groupBy("doc_type").count().collect()
    assert {r["doc_type"]: r["count"] for r in sample} == {"a": 3, "b": 2, "c": 2}
    assert [r["doc_id"] for r in measure.hardest(rows, 2).collect()] == [0, 1]
    assert rows.agg(measure.percentile("doc_id", 50).alias("p")).first()["p"] == 9.5
    assert measure.scale_corpus(rows.select("doc_id", F.col("name").alias("title")), 1, 20).count() == 20
    assert measure.scale_corpus(rows.select("doc_id", F.col("name").alias("title")), 3, 20).agg(F.max("doc_id")).first()[0] == 59


def test_self_queries(spark):
    texts = [(k, " ".join(["common"] * 3 + [f"special{'abcdefghij'[k]}word"] * 2 + [f"other{'abcdefghij'[k]}word"] * 3 + [f"third{'abcdefghij'[k]}word"] * 2)) for k in range(10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["query"] for r in measure.self_queries(docs, docs.select("doc_id", F.lit("otheraword").alias("name"))).collect()}
    assert 0 not in got and got[1] == "otherbword specialbword thirdbword"


def test_scores_of_unindexed_texts(spark):
    """As from an index, for ids that repeat and empty texts too; pairs of a query and a document are not shuffled."""
    rows = [(1, "binary trees and graphs trees"), (2, "hash tables"), (2, "tree tables"), (3, ""), (None, "graphs"), (4, None), (5, "graphs of trees")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = rank.query_terms(spark.createDataFrame([(7, "trees graphs"), (8, "tables"), (9, "")], "q long, text string"), "q", "text")
    allowed = docs.where("doc_id <> 5").select("doc_id").distinct()
    for only in (None, allowed):
        want = rank.bm25(index.weights(index.postings(docs), index.stats(docs)), terms, only)
        got = rank.bm25_of_texts(docs, terms, only)
        plain = lambda df: sorted((r["query_id"], str(r["doc_id"]), round(r["score"], 9)) for r in df.collect())
        assert plain(got) == plain(want) and got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id" not in plan


def test_catalogue_reads_texts_once(spark, catalog):
    asked = facets.Filters(course=frozenset({"CS1"}))
    first, again = catalog.search_content("trees", asked)[0], catalog.search_content("trees")[0]
    assert sorted(r["doc_id"] for r in first.collect()) == [0, 4] and again.count() == 2
    assert [k for k in catalog._read if k[0] == "content"] == [("content", "tree")]
