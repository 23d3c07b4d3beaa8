"""The pipeline on a small corpus with planted cases, stage by stage."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n=60: " ".join(word() for _ in range(n))
    item = text(20)
    rows = {k: text() for k in range(400)}
    for k in range(0, 400, 5):
        rows[k] += " vilest filth"
    rows[401], rows[402] = rows[7], rows[7]
    rows[403] = f"{text(30)} {item.upper()} {text(30)}"
    rows[404] = None
    base = tmp_path_factory.mktemp("pipeline")
    docs = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    toxic, copies = set(range(0, 400, 5)), {401, 402}
    want = [ids - toxic, ids - toxic - copies, ids - toxic - copies - {403}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert {r[0] for r in docs.select("doc_id").collect()} == want[k], name
    rows = docs.orderBy("start").collect()
    assert {r["doc_id"] for r in rows} <= want[2] and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows))


def test_stages_of_odd_rows(spark, folder, docs_of):
    word = " ".join(f"w{k}" for k in range(40_000))
    docs = docs_of([(1000, word), (1000, word), (None, None), (1001, ""), (1002, "few words")])
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0, name
        docs_now = stage(spark, docs, folder)
        n = docs_now.count()
        assert n == 5 if name != "source_mixing" else n >= 1, name
        if name != "token_output":
            assert docs_now.columns == docs.columns


def test_registration():
    import __spark_entry__ as driver

    names = set(driver.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
