"""Budgets, classification, content runs, settings, sinks, REST trees, manifests, folding, index pruning."""

import datetime
import json
import random
import re
import sys
import threading
import unicodedata
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.operators import content, index, order, rank, records, strategies, upsert
from lodestack.plans import classify, planner, reading, reports
from lodestack.settings import Settings
from lodestack.sources import tree
from lodestack.streaming import usage


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_budget():
    clock, stored = Clock(), []
    budget = classify.Budget(2, 5, store=lambda d, n: stored.append(n), clock=clock, sleep=clock.sleep, today=lambda: datetime.date(2024, 1, 1))
    for _ in range(5):
        budget.take()
    assert stored == [1, 2, 3, 4, 5] and clock.slept == [60.0, 60.0]
    with pytest.raises(classify.OverBudget):
        budget.take()
    assert stored[-1] == 5 and budget.left() == 0


def test_classification_keeps_what_came_before_an_error(spark):
    files = spark.createDataFrame([(k, "/p", f"{k}.pdf") for k in range(5)], "id long, path string, name string")
    reply = lambda ids: "```json\n" + json.dumps({"items": [{"id": i, "doc_type": "pyq", "exam_type": "quiz", "exam_number": None, "is_makeup": False} for i in ids]}) + "\n```"
    model = classify.canned([reply([0, 1, 77]), classify.ModelError("down"), reply([4])])
    found, why = classify.classify(files, model, classify.Budget(10, 10), size=2)
    assert why == "down" and {r["id"] for r in found.collect()} == {0, 1}
    found, why = classify.classify(files, classify.canned([reply([0]), "no json"]), classify.Budget(10, 2), size=2)
    assert why == "" and {r["id"] for r in found.collect()} == {0}
    none, why = classify.classify(files, classify.canned([]), classify.Budget(10, 0))
    assert none.count() == 0 and why and classify.classify(files.limit(0), classify.canned([]), classify.Budget(10, 0))[1] == ""


def test_content_run(spark, tmp_path):
    root = str(tmp_path / "cat")
    upsert.create_schema(spark, root)
    docs = spark.createDataFrame([(k, k, "pyq", "ok") for k in range(5)], "id long, raw_file_id long, doc_type string, link_status string")
    raw = spark.createDataFrame([(k, f"f{k}", f"/{9 - k}", "x.pdf", "pdf", datetime.date(2024, 1, 1)) for k in range(5)], "id long, drive_file_id string, path string, name string, extension string, modified_on date")
    full = lambda df, table: upsert.current(spark, root, table).unionByName(df, allowMissingColumns=True)
    upsert.publish_all(spark, root, {"documents": full(docs, "documents"), "raw_files": full(raw, "raw_files")})
    words = "readable words of a page " * 8

    def fetch(file):
        if file == "f1":
            raise OSError("gone")
        return file.encode()

    def read(data):
        if data == b"f2":
            raise ValueError("encrypted")
        return [words, words] if data != b"f3" else ["..", "%%"]

    monkey = reading.ATTEMPTS
    assert monkey == 4
    got = reading.run(spark, root, ["pyq"], fetch_fast(fetch), read, "2024-02-01 00:00:00", limit=4)
    assert got == {"read": 2, "failed": 1, "unreadable": 1}  # the last by path waits
    stored = {r["document_id"]: r for r in upsert.current(spark, root, "document_text").collect()}
    assert set(stored) == {2, 3, 4} and stored[4]["method"] == "text" and stored[4]["pages"] == 2 and stored[2]["method"] == stored[3]["method"] == "none"
    assert reading.run(spark, root, ["pyq"], lambda f: f.encode(), lambda d: [words], "2024-02-02 00:00:00") == {"read": 2, "failed": 0, "unreadable": 0}
    assert reading.run(spark, root, ["pyq"], fetch_fast(fetch), read, "2024-02-03 00:00:00") == {"read": 0, "failed": 0, "unreadable": 0}


def fetch_fast(fetch):
    """Failures that are not tried again."""

    def once(file):
        try:
            return fetch(file)
        except OSError:
            import lodestack.plans.reading as r

            r.time.sleep = lambda s: None
            raise

    return once


def test_fetching():
    tries = []

    def fetch(key):
        tries.append(key)
        if len(tries) < 3:
            raise OSError
        return b"x"

    clock = Clock()
    assert reading.fetched("k", fetch, clock.sleep) == b"x" and clock.slept == [1, 2]
    with pytest.raises(ValueError):
        reading.fetched("k", lambda k: bytes(reading.MOST_BYTES + 1))


def test_settings():
    s = Settings.from_mapping({"LODESTACK_REQUESTS_PER_DAY": " 7 ", "LODESTACK_RETIRE": "Yes", "LODESTACK_ALLOWED_DOMAINS": "A.edu, b.edu", "LODESTACK_MODEL_KEY": "hush"})
    assert (s.requests_per_day, s.retire, s.allowed_domains, s.model_key, s.ocr) == (7, True, ("a.edu", "b.edu"), "hush", "auto")
    assert "hush" not in repr(s) and Settings.from_mapping({}) == Settings()
    for name, value in (("REQUESTS_PER_DAY", "many"), ("REQUESTS_PER_MINUTE", "0"), ("MIN_QUALITY", "1.5"), ("OCR", "magic"), ("RETIRE", "perhaps")):
        with pytest.raises(ValueError, match=name):
            Settings.from_mapping({f"LODESTACK_{name}": value})


def test_sink():
    clock, posts = Clock(), []
    sink = usage.BufferedSink(posts.append, most=4, flush_at=3, clock=clock, sleep=clock.sleep)
    sink.send({"a": 1})
    sink.send({"a": 2})
    assert not posts
    sink.send({"a": 3})
    sink.send({"a": 4}, urgent=True)
    clock.now += 11
    sink.send({"a": 5})
    assert [len(json.loads(p)["events"]) for p in posts] == [3, 1, 1]

    def broken(body):
        raise OSError

    bad = usage.BufferedSink(broken, most=2, flush_at=9, clock=clock, sleep=clock.sleep)
    for k in range(3):
        bad.send({"a": k})
    bad.close()
    assert bad.dropped == 3 and bad.sent == 0
    usage.build_sink("").send({"a": 1})


def test_received(spark):
    tab = spark.createDataFrame([("a", "x")], "kind string, who string")
    new = spark.createDataFrame([("b", "=1+1", 3)], "kind string, note string, n int")
    out = usage.received(tab, new, "s", "s")
    assert out.columns == ["kind", "who", "note", "n"] and {r["note"] for r in out.collect()} == {None, "'=1+1"}
    with pytest.raises(PermissionError):
        usage.received(tab, new, "s", "t")


FOLDER, SHORTCUT = tree.FOLDER_MIME, tree.SHORTCUT_MIME
LISTING = {
    "root": [{"id": "d1", "name": "b", "mimeType": FOLDER}, {"id": "d2", "name": "a", "mimeType": FOLDER}, {"id": "x", "name": " ", "mimeType": "application/pdf"}],
    "d1": [{"id": "f1", "name": "one.pdf", "mimeType": "application/pdf", "modifiedTime": "2024-01-02T00:00:00Z", "webViewLink": "u1"}, {"id": "d2", "name": "again", "mimeType": FOLDER}],
    "d2": [{"id": "s1", "name": "short.pdf", "mimeType": SHORTCUT, "shortcutDetails": {"targetId": "f1", "targetMimeType": "application/pdf"}}, {"id": "s2", "name": "up", "mimeType": SHORTCUT, "shortcutDetails": {"targetId": "root", "targetMimeType": FOLDER}}],
}


class Server(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        asked = parse_qs(urlparse(self.path).query)
        rows, page = LISTING[asked["folder"][0]], int(asked.get("pageToken", ["0"])[0] or 0)
        body = json.dumps({"files": rows[page : page + 2], **({"nextPageToken": str(page + 2)} if page + 2 < len(rows) else {})}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_rest_tree(spark):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    endpoint = f"http://127.0.0.1:{server.server_port}/files"
    found = tree.Listed(tree.RestTree(spark, "root", endpoint, prefix="/top").fetch()).fetch().collect()
    assert [(r["drive_file_id"], r["path"], r["name"]) for r in found] == [("f1", "/top/a", "short.pdf")]
    with pytest.raises(ValueError):
        tree.RestTree(spark, "root", endpoint, most_folders=2).fetch()
    server.shutdown()


def test_manifests(spark, tmp_path):
    root = str(tmp_path / "m")
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    upsert.publish_all(spark, root, {"x": one, "y": one})
    upsert.publish(two, root, "x")
    (tmp_path / "m" / "_manifest" / "000000000003").mkdir()  # a writer that died: no _SUCCESS
    assert upsert.current(spark, root, "x").first()["a"] == 2 and upsert.current(spark, root, "y").first()["a"] == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY"):
        upsert.publish(one, root, "x")
    with pytest.raises(ValueError):
        upsert.current(spark, root, "z")


def test_schema_grows(spark, tmp_path):
    root = str(tmp_path / "s")
    upsert.publish(spark.createDataFrame([(1, "c")], "id long, code string"), root, "courses")
    upsert.create_schema(spark, root)
    assert upsert.current(spark, root, "courses").first().asDict() == {"id": 1, "code": "c", "name": None, "department_id": None}


def test_folding_equals_tokenizing(spark):
    rng = random.Random(0)
    odd = [i for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (text._fold(chr(i)) != chr(i) or unicodedata.combining(chr(i)))]
    points = sorted({*odd, *range(1, 0x400), *rng.sample(range(0xE000, sys.maxunicode), 3000)})
    rows = [(i, f"xy{chr(i)}9 {chr(i)}") for i in points]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, s string").select("i", text.tokens(F.col("s")).alias("t")).collect()}
    wrong = [(hex(i), got[i], text.tokenize(s)) for i, s in rows if got[i] != text.tokenize(s)]
    assert not wrong, (len(wrong), wrong[:5])


def test_index_lookups_open_the_slots_of_their_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{'abcdefghij'[k % 10]} common text {k}") for k in range(300)], "doc_id long, text string")
    path = str(tmp_path / "index")
    index.write_index(docs, path, slots=16)
    opened = index.open_weights(spark, path)
    terms = rank.query_terms(spark.createDataFrame([(1, "worda common")], "q long, t string"), "q", "t")
    found = rank.bm25(opened, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slot#\d+ IN \(\d+,\d+\)", plan) and "In(term, [" in plan
    want = strategies.Bm25Search(docs).search("worda common", 300)
    got = strategies.Bm25Search.of_index(spark, path).search("worda common", 300)
    rows = lambda df: [(r["doc_id"], round(r["score"], 9)) for r in df.collect()]
    assert rows(got) == rows(want) and found.count() == 300
    allowed = docs.where("doc_id < 20").select("doc_id")
    assert {r["doc_id"] for r in strategies.NaiveSearch(docs).search("worda common", 5, allowed).collect()} == {0, 10, 1, 2, 3}
    assert strategies.NaiveSearch(docs).search("the of", 5).count() == 0


def test_numbering_and_sections(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r["k"] == r["at"] for r in order.numbered(df, [F.col("k")], "at").collect())
    assert order.numbered(df.limit(0), [F.col("k")], "at").count() == 0
    both = planner.in_sections(df.where("k < 2"), df.where("k = 5"))
    assert sorted((r["section"], r["k"]) for r in both.collect()) == [(0, 0), (0, 1), (1, 5)]
    with pytest.raises(ValueError):
        records.count_by(df, "k")


def test_probe_kinds(spark):
    pages = spark.createDataFrame([(1, 0, "good text " * 20, None), (1, 1, "more good text " * 20, None), (2, 0, "", None), (3, None, None, "encrypted"), (4, None, None, "broken")], "doc_id int, page int, text string, error string")
    got = {r["doc_id"]: (r["kind"], len(r["snippet"])) for r in content.probe(pages).collect()}
    assert got == {1: ("text", 120), 2: ("scanned", 0), 3: ("encrypted", 0), 4: ("error", 0)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.23456, None), ("c", 2.0, 3)], "name string, x double, n int").orderBy("name")
    assert reports.write_csv(df, str(tmp_path / "r.csv")) == 2
    assert (tmp_path / "r.csv").read_text().splitlines() == ["name,x,n", "a|b,1.23456,", "c,2.0,3"]
    reports.write_markdown({"Speed": df}, str(tmp_path / "r.md"))
    assert "| a\\|b | 1.235 |  |" in (tmp_path / "r.md").read_text()
