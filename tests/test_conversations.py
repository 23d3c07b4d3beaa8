"""Forms carried through conversations, in tables and streams; scores of labelled messages; nested sections."""

import random

from pyspark.sql import functions as F

from lodestack.plans import chat, planner
from lodestack.streaming import conversations

ALIASES = {"cs1": "CS1", "maths": "MA1"}
SAYINGS = ["cs1 midsem papers", "also maths", "hello", "from 2019 and 2020", "last 2 years", "start over, slides", "plus quiz 3", "and trees and graphs", "", "thanks!", "compre solutions too", "newest", "notes on heaps", "q 2", None]


def rows_of(df):
    return sorted((r["conv_id"], r["turn"], *[str(r[c]) for c in (*chat.FIELDS, "understood", "smalltalk", "notes")]) for r in df.collect())


def turns_of(spark, n, seed=1):
    rng = random.Random(seed)
    return [(c, t, rng.choice(SAYINGS), "x") for c in range(4) for t in range(n)]


def test_a_conversation_is_the_fold_of_its_messages(spark):
    rows = turns_of(spark, 10)
    table = spark.createDataFrame(rows, "conv_id long, turn int, text string, notes string").repartition(3)
    got = {(r["conv_id"], r["turn"]): r for r in chat.parse_conversations(table, ALIASES).collect()}
    assert len(got) == len(rows)
    for c in (0,):
        form = chat.Form()
        for _, t, message, _ in [r for r in rows if r[0] == c]:
            one = chat.parse(message, ALIASES, form)
            r = got[c, t]
            form = one.form
            assert {f: tuple(r[f]) if f in chat.LISTS else r[f] for f in chat.FIELDS} == {f: getattr(form, f) for f in chat.FIELDS}, (c, t, message)
            assert (r["understood"], r["smalltalk"], tuple(r["notes"])) == (one.understood, one.smalltalk, one.notes)


def test_a_very_long_conversation(spark):
    n = 100_000
    table = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "cs1 papers").when(F.col("id") == n - 1, "also maths").otherwise("hello").alias("text"))
    got = chat.parse_conversations(table, ALIASES)
    last = got.where(f"turn = {n - 1}").first()
    assert got.count() == n and last["courses"] == ["CS1", "MA1"] and last["materials"] == ["papers"]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_streams_carry_the_form(spark, tmp_path):
    rows = turns_of(spark, 9, 2)
    schema = "conv_id long, turn int, text string, notes string"
    for k in range(3):  # three turns of every conversation in each micro-batch
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = conversations.parsed_stream(files, ALIASES).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(240)
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == rows_of(chat.parse_conversations(spark.createDataFrame(rows, schema), ALIASES))


def test_scores_with_kinds(spark):
    schema = "k int, message string, before string"
    cases = spark.createDataFrame([(1, "cs1 quiz papers", None), (2, "papers of 2019", None), (3, "hello", None), (4, "", None), (5, "also maths", "cs1 midsem papers")], schema)
    got = chat.replies(cases, ALIASES, "k", "message", "before")
    assert {r["k"]: r["kind"] for r in got.collect()} == {1: "confirm", 2: "clarify", 3: "smalltalk", 4: "unclear", 5: "confirm"}
    none = None
    expected = [
        (1, "confirm", ["CS1"], ["quiz"], ["papers"], [], none, none, none), (2, "clarify", [], [], ["slides"], [2019], none, none, none), (3, "smalltalk", ["XX"], [], [], [], none, none, none),
        (4, "clarify", [], [], [], [], none, [], none), (5, "confirm", ["MA1", "CS1"], ["midsem"], ["papers"], [], none, ["other"], none),
    ]
    table = spark.createDataFrame(expected, "k int, kind string, courses array<string>, exam_types array<string>, materials array<string>, years array<int>, recent_years int, topics array<string>, quiz_number int")
    r = chat.scored(table, got, "k").first().asDict()
    assert r == {"n": 5, "courses": 5, "exam_types": 5, "materials": 4, "years": 5, "recent_years": 5, "topics": 4, "quiz_number": 5, "whole_form": 3, "kind": 4, "clarify": 1, "clarify_due": 2}
    assert "kind" not in chat.scored(table.drop("kind"), got, "k").columns


def test_sections_nest(spark):
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id int")
    papers = planner.in_sections(df(1), df(2), df(3))
    more = planner.in_sections(df(4), df(5))
    both = planner.in_sections(papers, more, df(6))
    assert [r["doc_id"] for r in both.orderBy("section").collect()] == [1, 2, 3, 4, 5, 6] and len({r["section"] for r in both.collect()}) == 6
