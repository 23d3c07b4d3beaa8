"""Metadata rules: one row for each branch."""

import pytest
from pyspark.sql import functions as F

from lodestack.functions import rules

CASES = [
    ("/oop/Sem 1 21-22 (R)/Midsem", "Midsem 21-22.pdf", "pyq", "midsem", None, 2021),
    ("/oop/Sem 1 21-22/Quiz", "Quiz 2 soln.pdf", "solution", "quiz", 2, 2021),
    ("/oop/Notes", "Handout.pdf", "handout", "none", None, None),
    ("/oop/Labs", "sheet.pdf", "lab", "none", None, None),
    ("/oop/Lab Test 1", "paper.pdf", "pyq", "lab_quiz", 1, None),
    ("/oop/Tutorials", "tut 3 solutions.pdf", "tutorial", "none", None, None),
    ("/oop/Slides", "Series solution of ODE.pdf", "slides", "none", None, None),
    ("/oop", "Lec 4.pdf", "slides", "none", None, None),
    ("/oop", "marks.pdf", "grade_stats", "none", None, None),
    ("/oop/Past papers/x", "compre 19-20.pdf", "pyq", "compre", None, 2019),
    ("/oop", "qwerty.pdf", "unknown", "unknown", None, None),
    ("/oop/Quiz/Slides and Notes", "intro.pdf", "slides", "none", None, None),
    ("/oop/Midsem", "Midsem_Quiz 3.pdf", "pyq", "midsem", None, None),
]


def test_extract(spark):
    files = spark.createDataFrame([(k, p, n, "pdf") for k, (p, n, *_) in enumerate(CASES)], "k int, path string, name string, extension string")
    got = sorted(rules.extract(files, F.create_map(F.lit("oop"), F.lit(1))).collect(), key=lambda r: r["k"])
    for (path, name, *expected), r in zip(CASES, got):
        assert [r["doc_type"], r["exam_type"], r["exam_number"], r["academic_year"]] == expected, (path, name, r)
    assert got[0]["confidence"] == 0.95 and got[12]["confidence"] == 0.85 and got[10]["confidence"] == 0.0


def test_extract_of_nulls_and_strangers(spark):
    files = spark.createDataFrame([(None, None, None), ("/zz", "2031B5QT4321Z.pdf", "pdf")], "path string, name string, extension string")
    got = rules.extract(files, F.create_map(F.lit("oop"), F.lit(1))).collect()
    assert {r["confidence"] for r in got} == {0.0}
    assert any("student id" in n for r in got for n in r["notes"])


@pytest.mark.parametrize(
    "stem, expected",
    [("21-22", (2021, True)), ("exam 2018", (2018, False)), ("2021", (2020, True)), ("2022", (2022, False)), ("Lecture-16-17", (None, False)), ("unit 16-17 and 18-19", (2018, True)), ("2023 24", (2023, True)), ("2031B5QT4321Z 21-22", (None, False)), ("", (None, False)), (None, (None, False))],
)
def test_years(spark, stem, expected):
    row = spark.createDataFrame([(stem,)], "stem string").select(rules.year_from_name(F.col("stem")).alias("y")).first()["y"]
    assert (row["year"], row["is_span"]) == expected


def test_verdicts_fill_gaps_only(spark):
    meta = spark.createDataFrame(
        [(1, "unknown", "unknown", None, False, 0.0, "rule", ["x"]), (2, "slides", "none", None, False, 0.9, "rule", []), (3, "pyq", "unknown", None, False, 0.2, "rule", [])],
        "id int, doc_type string, exam_type string, exam_number int, is_makeup boolean, confidence double, method string, notes array<string>",
    )
    said = spark.createDataFrame([(1, "notes", "unknown", None, False), (2, "pyq", "quiz", 3, False), (3, "slides", "quiz", 2, True)], "id int, v_doc_type string, v_exam_type string, v_exam_number int, v_is_makeup boolean")
    got = {r["id"]: r for r in rules.apply_verdict(meta, said, "id").collect()}
    assert (got[1]["doc_type"], got[1]["exam_type"], got[1]["method"]) == ("notes", "none", "llm")
    assert (got[2]["doc_type"], got[2]["method"], got[2]["confidence"]) == ("slides", "rule", 0.9)
    assert (got[3]["doc_type"], got[3]["exam_type"], got[3]["exam_number"], got[3]["is_makeup"], got[3]["confidence"]) == ("pyq", "quiz", 2, True, 0.65)
