"""Content runs that commit as they go, guarded readers, downloads, parts and migrations, streaming rules, the sink's sender."""

import datetime
import json
import os
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestack.operators import upsert
from lodestack.operators import usage as batch_usage
from lodestack.plans import reading
from lodestack.sources import download, guard, pdf
from lodestack.streaming import usage

WORDS = "readable words of a page " * 8


@pytest.fixture
def catalogue(spark, tmp_path):
    """A stored catalogue of n pending files f0, f1, ... in this order."""

    def make(n):
        root = str(tmp_path / "cat")
        upsert.create_schema(spark, root)
        docs = spark.createDataFrame([(k, k, "pyq", "ok") for k in range(n)], "id long, raw_file_id long, doc_type string, link_status string")
        raw = spark.createDataFrame([(k, f"f{k}", f"/{k:03d}", "x.pdf", "pdf", datetime.date(2024, 1, 1)) for k in range(n)], "id long, drive_file_id string, path string, name string, extension string, modified_on date")
        full = lambda df, table: upsert.current(spark, root, table).unionByName(df, allowMissingColumns=True)
        upsert.publish_all(spark, root, {"documents": full(docs, "documents"), "raw_files": full(raw, "raw_files")})
        return root

    return make


def stored(spark, root):
    return {r["document_id"]: r for r in upsert.current(spark, root, "document_text").collect()}


def test_a_broken_run_keeps_its_finished_batches(spark, catalogue):
    root = catalogue(7)

    def fetch(file):
        if file == "f5":
            raise RuntimeError("the machine went away")  # no error of a file: the job fails
        return file.encode()

    with pytest.raises(Exception, match="went away"):
        reading.run(spark, root, ["pyq"], fetch, lambda d: [WORDS], "2024-02-01 00:00:00", batch=2)
    assert set(stored(spark, root)) == {0, 1, 2, 3}
    seen = []
    assert reading.run(spark, root, ["pyq"], lambda f: f.encode(), lambda d: [WORDS], "2024-02-02 00:00:00", batch=2) == {"read": 3, "failed": 0, "unreadable": 0}
    got = stored(spark, root)
    assert set(got) == set(range(7)) and got[0]["created_at"] < got[6]["created_at"] and not seen
    assert reading.run(spark, root, ["pyq"], lambda f: f.encode(), lambda d: [WORDS + "new"], "2024-02-03 00:00:00", force=True, batch=3)["read"] == 7
    got = stored(spark, root)
    assert len(got) == 7 and all(r["text"].endswith("new") for r in got.values())


def test_scans_become_text(spark, catalogue):
    root = catalogue(4)
    pages = {b"f0": [WORDS, WORDS], b"f1": ["", WORDS, ""], b"f2": ["", ""], b"f3": [""]}

    def engine():
        def read(data, page):
            if data == b"f2":
                raise RuntimeError("no engine can read this")
            return f"{WORDS} scanned {page}" if data == b"f1" else "short"

        return read

    got = reading.run(spark, root, ["pyq"], lambda f: f.encode(), pages.__getitem__, "2024-02-01 00:00:00", ocr=engine)
    assert got == {"read": 4, "failed": 0, "unreadable": 0, "ocr": 2}
    rows = stored(spark, root)
    assert [rows[k]["method"] for k in range(4)] == ["text", "ocr", "none", "none"]
    assert "scanned 0" in rows[1]["text"] and "scanned 2" in rows[1]["text"] and "scanned 1" not in rows[1]["text"]


def test_readers_cannot_take_a_task_down(spark, catalogue):
    root = catalogue(5)

    def read(data):
        if data == b"f0":
            raise KeyError("/Root")
        if data == b"f1":
            time.sleep(60)
        if data == b"f2":
            os._exit(3)
        if data == b"f3":
            return [None, 7]
        return [WORDS]

    todo = spark.createDataFrame([(k, f"f{k}", datetime.date(2024, 1, 1)) for k in range(5)], "id long, drive_file_id string, modified_on date").coalesce(1)
    rows = reading.read_files(todo, lambda f: f.encode(), read, seconds=2).collect()
    why = {r["document_id"]: (r["outcome"], r["error"]) for r in rows}
    assert why[0] == ("unreadable", "KeyError: '/Root'") and why[1][0] == "unreadable" and "no answer" in why[1][1] and why[2] == ("unreadable", "the reader's process died")
    assert [r["text"] for r in rows if r["document_id"] == 3] == ["", "7"] and why[4] == ("read", None)
    assert reading.run(spark, root, ["pyq"], lambda f: f.encode(), read, "2024-02-01 00:00:00", seconds=2) == {"read": 2, "failed": 0, "unreadable": 3}
    files = spark.createDataFrame([("p", b"x"), ("q", b"y")], "path string, content binary")

    def hangs(data):
        if data == b"x":
            time.sleep(60)
        return ["fine"]

    assert sorted((r["path"], r["text"] or "", bool(r["error"])) for r in pdf.read_pages(files, hangs, seconds=1).collect()) == [("p", "", True), ("q", "fine", False)]


def test_guard_makes_an_engine_once():
    made = guard.Guarded(lambda: (lambda n, seen=[]: seen.append(n) or len(seen)), 5)
    assert [made(k) for k in range(3)] == [1, 2, 3]
    made.close()
    assert made(0) == 1
    made.close()


class Files(BaseHTTPRequestHandler):
    tries: dict = {}

    def do_GET(self):  # noqa: N802
        key = self.path.split("/")[-1].split("?")[0]
        Files.tries[key] = Files.tries.get(key, 0) + 1
        if key == "flaky" and Files.tries[key] < 3:
            return self.send_error(503)
        if key == "none":
            return self.send_error(404)
        self.send_response(200)
        if key == "announced":
            self.send_header("Content-Length", str(1 << 40))
        self.end_headers()
        try:
            for _ in range(200 if key == "endless" else 2):
                self.wfile.write(b"x" * 50_000)
        except OSError:
            pass

    def log_message(self, *args):
        pass


def test_downloads(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    endpoint = f"http://127.0.0.1:{server.server_port}/files"
    fetch = download.Downloader(endpoint, most=200_000, sleep=lambda s: None)
    assert len(fetch("plain")) == 100_000 and len(fetch("flaky")) == 100_000 and Files.tries["flaky"] == 3
    with pytest.raises(OSError, match="404"):
        fetch("none")
    assert Files.tries["none"] == 1
    for key in ("endless", "announced"):
        with pytest.raises(download.TooLarge):
            fetch(key)

    class Counted:
        def __init__(self):
            self.given = 0

        def read(self, n):
            self.given += n
            return b"y" * n

    stream = Counted()
    with pytest.raises(download.TooLarge):
        download.read_capped(stream, 5_000_000)
    assert stream.given == 5_000_001
    spark.dataSource.register(download.DownloadSource)
    rows = spark.read.format("downloads").option("endpoint", endpoint).option("ids", json.dumps(["plain", "endless", "none"])).option("most", "200000").option("partitions", "2").load()
    got = {r["id"]: (len(r["content"] or b""), r["error"]) for r in rows.collect()}
    assert got["plain"] == (100_000, None) and got["endless"][0] == 0 and "TooLarge" in got["endless"][1] and "404" in got["none"][1]
    table = spark.createDataFrame([("plain",), ("none",)], "id string")
    assert {r["id"]: r["error"] is None for r in download.downloaded(table, fetch).collect()} == {"plain": True, "none": False}
    server.shutdown()


def test_parts_stay_few(spark, tmp_path):
    root = str(tmp_path / "parts")
    upsert.create_schema(spark, root)
    columns = upsert.current(spark, root, "document_text").columns
    for k in range(9):
        new = spark.createDataFrame([(j, f"m{k}") for j in (2 * k, 2 * k + 1, 0)], "document_id long, method string").dropDuplicates(["document_id"])
        upsert.append(spark, root, {"document_text": spark.createDataFrame([], upsert.TABLES["document_text"]).unionByName(new, allowMissingColumns=True).select(*columns)})
        got = {r["document_id"]: r["method"] for r in upsert.current(spark, root, "document_text").collect()}
        assert len(got) == 2 * k + 2 and got[0] == f"m{k}" and got[1] == "m0"
    assert len(upsert._manifest(spark, root).tables["document_text"]) <= 5


def test_migration(spark, tmp_path):
    def old(root, rows, schema=1):
        part = {"documents": "d1", "courses": "c1"}
        spark.createDataFrame(rows, "id long, name string").write.parquet(f"{root}/documents/d1")
        spark.createDataFrame([(1, "CS1", "x", 1)], upsert.TABLES["courses"]).write.parquet(f"{root}/courses/c1")
        spark.createDataFrame([(t, v, schema) for t, v in part.items()], "name string, version string, schema_version int").coalesce(1).write.parquet(f"{root}/_manifest/{1:012d}")

    empty, full, new = (str(tmp_path / x) for x in ("empty", "full", "new"))
    old(empty, [])
    with pytest.raises(ValueError, match="migrate"):
        upsert.current(spark, empty, "courses")
    assert upsert.migrate(spark, empty) == [1] and upsert.migrate(spark, empty) == []
    upsert.create_schema(spark, empty)
    assert upsert.current(spark, empty, "courses").first()["code"] == "CS1" and "raw_file_id" in upsert.current(spark, empty, "documents").columns
    old(full, [(1, "a")])
    for verb in (upsert.migrate, upsert.create_schema):
        with pytest.raises(ValueError, match="holds 1 rows"):
            verb(spark, full)
    assert len(os.listdir(f"{full}/_manifest")) == 1
    old(new, [], schema=99)
    with pytest.raises(ValueError, match="its own release"):
        upsert.migrate(spark, new)


def streamed(spark, tmp_path, rows, schema, apply, batches):
    """Rows of a stream that brings ``batches`` lists of rows, one after another."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/{k:03d}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = apply(files).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination(240)
    return spark.read.parquet(out)


def dealt(rows, n, rng, late=20):
    """Rows in n batches, each up to ``late`` seconds out of order; a last batch far ahead lets the watermark pass all."""
    rows = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, late))
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def test_streaming_rate_limit_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda s: start + datetime.timedelta(seconds=s)
    rows = [(rng.randrange(5), at(rng.randrange(600)), k) for k in range(400)]
    schema = "user_id long, at timestamp, event_id long"
    ahead = [(99, at(5000), 9999)], [(99, at(9000), 9998)]
    got = streamed(spark, tmp_path, rows, schema, lambda e: usage.rate_limited(e, "user_id", "at", "event_id", 5, 60, "60 seconds"), [*dealt(rows, 4, rng), *ahead])
    table = spark.createDataFrame(rows, schema).withColumn("t", F.col("at").cast("double"))
    want = {(r["user_id"], r["event_id"]) for r in batch_usage.rate_limited(table, "user_id", "t", "event_id", 5, 60).collect()}
    assert {(r["user_id"], r["event_id"]) for r in got.where("user_id < 99").collect()} == want and 0 < len(want) < 400


def test_streaming_reports_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(k, start + datetime.timedelta(minutes=rng.randrange(6000)), rng.randrange(6), rng.choice(["wrong_info", "broken_link"])) for k in range(200)]
    schema = "id long, created_at timestamp, document_id long, type string"
    known = spark.createDataFrame([(k,) for k in range(5)], "document_id long")
    ahead = [(900, start + datetime.timedelta(days=30), 0, "x")], [(901, start + datetime.timedelta(days=90), 0, "x")]
    got = streamed(spark, tmp_path, rows, schema, lambda e: usage.new_reports(e, known, delay="1 hour"), [*dealt(rows, 3, rng, 3000), *ahead])
    want = {r["id"] for r in batch_usage.new_reports(spark.createDataFrame(rows, schema), known).collect()}
    assert {r["id"] for r in got.where("id < 900").collect()} == want and 0 < len(want) < 200


def until(condition, seconds=5):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.02)
    return condition()


def test_sink_sends_on_its_own():
    posts = []
    sink = usage.BackgroundSink(posts.append, flush_at=3, seconds=0.3, secret="s")
    sink.send({"a": 1})
    assert not posts and until(lambda: posts)  # an idle event leaves within the interval
    assert json.loads(posts[0]) == {"events": [{"a": 1}], "secret": "s"}
    sink.close()
    slow, waiting = threading.Event(), []
    sink = usage.BackgroundSink(lambda body: (waiting.append(body), slow.wait(5)), most=4, flush_at=2, seconds=60)
    sink.send({"a": 1}, urgent=True)
    assert until(lambda: waiting)
    began = time.time()
    for k in range(6):
        sink.send({"a": k})
    assert time.time() - began < 0.5 and sink.dropped == 2  # a slow receiver holds nobody up
    slow.set()
    sink.close()
    assert sink.sent == 5 and [len(json.loads(w)["events"]) for w in waiting] == [1, 2, 2]

    def broken(body):
        raise ValueError("no OSError")

    sink = usage.BackgroundSink(broken, flush_at=1, seconds=60)
    sink.send({"a": 1})
    assert until(lambda: not sink.held) and sink._sender.is_alive()
    sink.post = posts.append
    sink.send({"a": 2})
    assert until(lambda: b'"a": 2' in posts[-1])
    sink.close()
