"""Upserts, syncs, sources, usage rules, streaming."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from lodestack.operators import compare, content, upsert, usage
from lodestack.plans import chat, engine
from lodestack.sources import files, tree


def ts(x):
    return F.to_timestamp(F.lit(x))


def test_upsert_template(spark):
    old = spark.createDataFrame([(1, "a", 1, False), (2, "b", 2, True), (3, "c", 3, False)], "k long, v string, first long, locked boolean")
    new = spark.createDataFrame([(1, "A", 9, False), (2, "B", 9, False), (4, None, 9, False)], "k long, v string, first long, locked boolean")
    got = {r["k"]: (r["v"], r["first"]) for r in upsert.upsert(old, new, "k", keep=["first"], guard=F.col("o.locked")).collect()}
    assert got == {1: ("A", 1), 2: ("b", 2), 3: ("c", 3), 4: (None, 9)}
    assert upsert.upsert_counts(old, new.union(new), "k").first().asDict() == {"seen": 6, "inserted": 1, "updated": 5}
    assert upsert.upsert(old, new.limit(0), "k").count() == 3


def test_queue(spark):
    queue = spark.createDataFrame([(1, "r", "open"), (2, "r", "resolved"), (3, "r", "open")], "document_id long, reason string, status string").withColumn("created_at", ts("2024-01-01")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    got = {r["document_id"]: (r["status"], r["newly_opened"], r["auto_resolved"]) for r in upsert.sync_queue(queue, spark.createDataFrame([(1, "x"), (2, "x"), (9, "x")], "document_id long, reason string"), ts("2024-02-01")).collect()}
    assert got == {1: ("open", False, False), 2: ("open", True, False), 3: ("resolved", False, True), 9: ("open", True, False)}


def listing(spark, ids):
    return spark.createDataFrame([(i, f"/OOP/Midsem {i}", f"{i}.pdf", "pdf", "application/pdf", None, f"https://x/d/{i}", True) for i in ids], "drive_file_id string, path string, name string, extension string, mime_type string, modified_on date, url string, is_indexable boolean")


def test_sync_and_extract(spark, tmp_path):
    root = str(tmp_path / "cat")
    upsert.create_schema(spark, root)
    upsert.publish(spark.createDataFrame([("oop", "OOP", 5, True)], "alias_norm string, alias string, course_id long, verified boolean"), root, "course_aliases")
    upsert.publish(spark.createDataFrame([(5, "CS5", "Objects", 1)], "id long, code string, name string, department_id long"), root, "courses")
    many = [f"f{k}" for k in range(24)]
    assert engine.sync(spark, root, listing(spark, many), 1, "2024-01-01 00:00:00") == {"seen": 24, "inserted": 24, "updated": 0, "retired": 0, "restored": 0}
    assert engine.extract(spark, root, "2024-01-01 00:00:00") == 24
    with pytest.raises(ValueError):
        engine.sync(spark, root, listing(spark, many[:3]), 1, "2024-01-02 00:00:00", retire=True)
    assert engine.sync(spark, root, listing(spark, many[:20]), 1, "2024-01-03 00:00:00", retire=True)["retired"] == 4
    assert engine.sync(spark, root, listing(spark, many), 1, "2024-01-04 00:00:00", retire=True)["restored"] == 4
    raw = upsert.current(spark, root, "raw_files")
    assert raw.count() == 24 and {str(r[0]) for r in raw.select("first_seen_at").distinct().collect()} == {"2024-01-01 00:00:00"}
    assert engine.extract(spark, root, "2024-02-01 00:00:00") == 24
    view = engine.document_view(upsert.current(spark, root, "documents"), raw, upsert.current(spark, root, "courses"))
    assert {(r["course_code"], r["exam_type"]) for r in view.collect()} == {("CS5", "midsem")}
    counts = upsert.export_snapshot(spark, root, str(tmp_path / "out"))
    assert counts["documents"] == 24 and counts["search_logs"] == 0
    with pytest.raises(ValueError):
        upsert.export_snapshot(spark, root, root)


def test_corrections(spark):
    docs = spark.createDataFrame([(1, "unknown", "rule", 0.1, False), (2, "pyq", "rule", 0.9, False)], "id long, doc_type string, extraction_method string, extraction_confidence double, reviewed boolean")
    got = {r["id"]: tuple(r)[1:] for r in upsert.mark_manual(docs, spark.createDataFrame([(1, "notes")], "id long, doc_type string")).collect()}
    assert got == {1: ("notes", "manual", 1.0, True), 2: ("pyq", "rule", 0.9, False)}
    with pytest.raises(ValueError):
        upsert.mark_manual(docs, spark.createDataFrame([(1, "x")], "id long, title string"))


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "list.csv"
    p.write_text('﻿path,name,mime_type,modified,url\n/A,"Say ""hi"".pdf",application/pdf,2/29/2024,https://x/d/AB\n/A,b.pdf,application/pdf,2/30/2024,https://x/d/CD\n/A,c.pdf,,,none\n', encoding="utf-8")
    good, bad = files.read_listing(spark, str(p))
    assert [(r["drive_file_id"], r["name"], str(r["modified_on"])) for r in good.collect()] == [("AB", 'Say "hi".pdf', "2024-02-29")]
    assert {r["bad"] for r in bad.collect()} == {"not a date", "no id in the link"}
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), ["nope"])


def test_chat_cases_seeds_review(spark):
    rows = spark.createDataFrame([("m", "", "confirm", "A;B;A", "quiz", "default", "2021", "x", "t", ""), ("m", "", "odd", "", "", "", "", "", "", "")], "message string, previous_message string, kind string, courses string, exam_types string, materials string, years string, recent_years string, topics string, quiz_number string")
    good, odd = sorted(files.chat_cases(rows).collect(), key=lambda r: r["kind"])
    assert good["courses"] == ["A", "B"] and len(good["materials"]) == 5 and good["bad"] == "recent_years is no number" and odd["bad"] == "unknown kind"
    seeds = files.seeds(spark.createDataFrame([("oop", "CS 5", "Object Things", "CS", "yes")], "alias string, course_code string, course_name string, department string, verified string"))
    assert {r["alias_norm"] for r in seeds.collect()} == {"oop", "cs5", "objectthings"}
    review = spark.createDataFrame([("a", "pyq", "quiz", "2", "2021", "yes", "no", ""), ("b", "pyq", "unknown", "99", "x", "maybe", "", "zz")], "drive_file_id string, doc_type string, exam_type string, exam_number string, academic_year string, is_makeup string, has_solution string, syllabus_scope string")
    errors = {r["drive_file_id"]: r["errors"] for r in files.review_rows(review).collect()}
    assert errors == {"a": [], "b": ["unknown left", "exam_number", "academic_year", "is_makeup", "syllabus_scope"]}


def test_tree(spark):
    edges = spark.createDataFrame([("r", "a", "A"), ("r", "b", "B"), ("a", "c", "C"), ("b", "c", "C2"), ("c", "r", "back")], "parent string, child string, name string")
    folders = tree.walk(edges, "r")
    assert {(r["folder"], r["path"]) for r in folders.collect()} == {("r", ""), ("a", "/A"), ("b", "/B"), ("c", "/A/C")}
    with pytest.raises(ValueError):
        tree.walk(edges, "r", most_folders=2)
    s = "application/vnd.google-apps.shortcut"
    items = spark.createDataFrame([("a", "1", "x.pdf", "application/pdf", None, None, "2024-01-02T00:00Z", "u"), ("b", "s", "x again.pdf", s, "1", "application/pdf", "", ""), ("b", "2", " ", "application/pdf", None, None, "", ""), ("c", "3", "dead", s, None, None, "", "")], "folder string, id string, name string, mime_type string, target_id string, target_mime string, modified string, url string")
    assert [(r["drive_file_id"], r["path"], str(r["modified_on"])) for r in tree.listed_files(items, folders).collect()] == [("1", "/A", "2024-01-02")]


def test_retry():
    replies = iter([(500, ""), (403, "rateLimitExceeded"), (200, '{"a": 1}')])
    waits = []
    assert tree.fetch("u", lambda _: next(replies), waits.append) == {"a": 1} and waits == [1, 2]
    with pytest.raises(OSError, match="no access"):
        tree.fetch("u", lambda _: (404, ""), waits.append)
    with pytest.raises(OSError):
        tree.fetch("u", lambda _: (503, ""), lambda _: None)


def test_compare_and_profile(spark):
    got = {r["change"]: (r["n"], r["examples"]) for r in compare.compare(listing(spark, ["a", "b"]), listing(spark, ["b", "c"])).collect()}
    assert got == {"added": (1, ["c"]), "removed": (1, ["a"]), "same": (1, ["b"])}
    assert {(r["kind"], r["n"]) for r in compare.profile(listing(spark, ["a"])).collect()} == {("total", 1), ("indexable", 1), ("folder", 1), ("extension", 1)}


def test_anchored_repeats(spark):
    times = [0, 8, 12, 15, 22, 40]
    e = spark.createDataFrame([(1, t, k, "q") for k, t in enumerate(times)] + [(2, 0, 90, None), (2, 1, 91, "z"), (2, 2, 92, "q")], "u long, t long, id long, key string")
    got = sorted(r["id"] for r in usage.dedupe(e, "u", "t", "id", "key").collect())
    assert [times[i] for i in got if i < 90] == [0, 12, 22, 40] and got[4:] == [90, 91, 92]


def test_rate_limit(spark):
    e = spark.createDataFrame([(1, t, t) for t in (0, 1, 2, 9, 10, 11)], "u long, t long, id long")
    assert sorted(r["id"] for r in usage.rate_limited(e, "u", "t", "id", 2, 10).collect()) == [0, 1, 10, 11]


def test_streaming_repeats_equal_batch(spark, tmp_path):
    from lodestack.streaming import usage as live

    rows = [(u, k, float(t), "ab"[t % 2]) for u in (1, 2) for k, t in enumerate([0, 2, 4, 9, 14, 16, 30], 10 * u)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double, key string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.logged(stream, 10).writeStream.format("memory").queryName("logged_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select user_id, event_id from logged_events").collect())
    assert got == sorted(tuple(r) for r in usage.dedupe(df, "user_id", "t", "event_id", "key").collect())


def test_sink_batches_and_drops(spark):
    from lodestack.streaming.usage import deliver

    rows = spark.range(7).collect()
    sent, waits = [], []
    assert deliver(rows, lambda b: sent.append(len(json.loads(b)["events"])), size=3) == (7, 0) and sent == [3, 3, 1]

    def fail(_):
        raise OSError

    assert deliver(rows[:2], fail, sleep=waits.append) == (0, 2) and waits == [1, 2]


def test_content_gate(spark):
    pages = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([0, 79, 80, 200])] + [(2, 0, None)], "doc_id long, page int, text string")
    got = {r["doc_id"]: (r["coverage"], r["kind"]) for r in content.probe(pages).collect()}
    assert got == {1: (0.5, "mixed"), 2: (0.0, "scanned")}
    assert {r["page"] for r in content.pages_to_ocr(pages.where("doc_id = 1")).collect()} == {0, 1}
    read = spark.createDataFrame([("good words here", "text", 0.9), ("g00d w0rds", "text", 0.9), ("good words", "ocr", 0.4)], "text string, method string, coverage double")
    assert [r["method"] for r in content.gate(read).collect()] == ["text", "none", "none"]


def test_pdf_pages_through_a_fake_reader(spark):
    from lodestack.sources.pdf import read_pages

    def read(data):
        if data == b"bad":
            raise ValueError("encrypted")
        return data.decode().split("|")

    df = spark.createDataFrame([("p", bytearray(b"a|b")), ("q", bytearray(b"bad"))], "path string, content binary")
    assert sorted((r["path"], r["text"] or "", r["error"] or "") for r in read_pages(df, read).collect()) == [("p", "a", ""), ("p", "b", ""), ("q", "", "encrypted")]


ALIASES = {"oop": "CS1", "logicincs": "CS2"}


@pytest.mark.parametrize(
    "message, field, value",
    [
        ("OOP midsem papers from the last 3 years", "recent_years", 3),
        ("logic in cs compre 2021-22 and 22-23", "years", (2021, 2022)),
        ("oop 10-15", "topics", ("10-15",)),
        ("oop quiz 2 solutions", "quiz_number", 2),
        ("oop everything", "materials", ("papers", "solutions", "notes", "slides", "tutorials", "assignments", "labs")),
        ("notes on virtual functions and some templates please", "topics", ("virtual functions", "templates")),
        ("oop lab test", "exam_types", ("lab_quiz",)),
        ("oop latest papers", "recent_years", 1),
        ("oop", "materials", ("papers", "solutions", "notes", "slides", "tutorials")),
    ],
)
def test_messages(spark, message, field, value):
    assert getattr(chat.parse(message, ALIASES).form, field) == value


def test_refinement(spark):
    first = chat.parse("oop midsem papers 2021", ALIASES).form
    assert chat.parse("also notes", ALIASES, first).form.materials == ("papers", "notes")
    assert chat.parse("compre", ALIASES, first).form == dataclasses.replace(first, exam_types=("compre",))
    assert chat.parse("last 2 years", ALIASES, first).form.years == ()
    assert chat.parse("start over: logic in cs notes", ALIASES, first).form.exam_types == ()
    assert chat.parse("thanks!!", ALIASES, first).smalltalk == "thanks"


def test_bulk_messages(spark):
    turns = spark.createDataFrame([(1, 0, "oop midsem"), (1, 1, "also notes"), (2, 0, None)], "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.parse_conversations(turns, ALIASES).collect()}
    assert got[1, 1]["courses"] == ["CS1"] and got[1, 1]["materials"][-1] == "notes" or "notes" in got[1, 1]["materials"]
    assert not got[2, 0]["understood"]
    same = chat.parse_messages(turns.where("turn = 0").withColumn("k", F.col("conv_id")), ALIASES, "k", "text")
    assert chat.scored(same, same, "k").first()["whole_form"] == 2
