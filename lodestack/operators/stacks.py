"""Grouping hits into stacks, their order, paging, and the card of one hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.listing import safe_url
from ..functions.text import labelled, year_label
from ..vocabulary import DOC_TYPE_LABELS, EXAM_TYPE_LABELS, KIND_ORDER, NUMBERED_EXAMS, PAPER_TYPES, SHOWN_EXAMS


def kind() -> Column:
    return F.when(F.col("doc_type").isin(PAPER_TYPES), "papers").otherwise(F.col("doc_type"))


def exam() -> Column:
    return F.when(F.col("doc_type").isin(PAPER_TYPES) & F.col("exam_type").isin(SHOWN_EXAMS), F.col("exam_type")).otherwise("")


def kind_label(k: Column, e: Column) -> Column:
    papers = F.when(e == "", "Exam papers").otherwise(F.concat(labelled(e, EXAM_TYPE_LABELS), F.lit(" papers")))
    return F.when(k == "papers", papers).otherwise(labelled(k, DOC_TYPE_LABELS))


def members(hits: DataFrame) -> DataFrame:
    """hits with kind, exam and their place inside their stack: papers newest first, all else best first."""
    year = F.coalesce("academic_year", F.lit(0))
    by = hits.withColumn("kind", kind()).withColumn("exam", exam())
    first = F.when(F.col("kind") == "papers", year.cast("double")).otherwise(F.col("score"))
    second = F.when(F.col("kind") == "papers", F.col("score")).otherwise(year.cast("double"))
    w = Window.partitionBy("course_code", "kind", "exam").orderBy(first.desc(), second.desc(), "name", "doc_id")
    return by.withColumn("place", F.row_number().over(w))


def year_span(years: Column) -> Column:
    first, last = F.get(years, F.lit(0)), F.get(F.reverse(years), F.lit(0))
    return F.when(F.size(years) == 0, "").when(first == last, year_label(first)).otherwise(F.concat(year_label(first), F.lit(" to "), year_label(last)))


def stacks(hits: DataFrame) -> DataFrame:
    """One row for each (course, kind, exam), in order: key, title, best_score, years, year_span, solutions, size, place.

    hits: the document view with doc_id and score, at most the result cap of them. Stacks come best score first, then
    by kind, then by title.
    """
    solution = (F.col("doc_type") == "solution") | F.col("has_solution")
    found = members(hits).groupBy("course_code", "kind", "exam").agg(
        F.max("score").alias("best_score"),
        F.array_sort(F.collect_set("academic_year")).alias("years"),
        F.count_if(solution).alias("solution_count"),
        F.count("*").alias("size"),
        F.min_by("course_name", "place").alias("course_name"),
    )
    label = kind_label(F.col("kind"), F.col("exam"))
    course = F.when(F.coalesce("course_name", F.lit("")) != "", F.col("course_name")).otherwise(F.col("course_code"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    titled = found.withColumn("title", F.when(F.col("course_code") != "", F.concat_ws(" · ", course, label)).otherwise(label))
    titled = titled.withColumn("key", F.concat_ws("|", "course_code", "kind", "exam")).withColumn("year_span", year_span(F.col("years")))
    order = Window.orderBy(F.round("best_score", 6).desc(), F.when(rank > 0, rank).otherwise(len(KIND_ORDER) + 1), "title", "key")
    return titled.withColumn("place", F.row_number().over(order)).drop("course_name")


def page(found: DataFrame, offset: int, limit: int) -> DataFrame:
    """Stacks offset+1 .. offset+limit, each with has_more."""
    whole = found.withColumn("total", F.count("*").over(Window.partitionBy(F.lit(0))))
    return whole.where(F.col("place").between(offset + 1, offset + limit)).withColumn("has_more", F.col("total") > offset + limit).drop("total")


def exam_label(exam_type: Column, number: Column, makeup: Column) -> Column:
    """"Quiz 2 (make-up)"; empty for exams that are not shown, a number only where exams are numbered."""
    numbered = F.when(exam_type.isin(NUMBERED_EXAMS) & number.isNotNull(), F.concat(F.lit(" "), number.cast("string"))).otherwise("")
    full = F.concat(labelled(exam_type, EXAM_TYPE_LABELS), numbered, F.when(makeup, " (make-up)").otherwise(""))
    return F.when(exam_type.isin(SHOWN_EXAMS), full).otherwise("")


#: Sentences shown with a hit. Fixed values.
UNREADABLE = "The text inside this file could not be read (scan or handwriting), so it was not checked for your topics. Shown because its course and exam match."
PAIRED = "The solution for a paper that mentions your topics."
BY_FILTERS = "Matches your filters."


def why_matched(source: Column, terms: Column) -> Column:
    """One sentence that says why a hit is listed."""
    words = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("“"), t, F.lit("”"))), ", ")
    some = F.size(terms) > 0
    return (
        F.when(source == "unreadable", UNREADABLE)
        .when(source == "paired", PAIRED)
        .when((source == "content") & some, F.concat(F.lit("Mentions "), words, F.lit(" inside the file.")))
        .when(some, F.concat(F.lit("Matches "), words, F.lit(" in the file name or folder.")))
        .otherwise(BY_FILTERS)
    )


def cards(hits: DataFrame) -> DataFrame:
    """The fields that a result page shows of each hit."""
    return hits.select(
        "doc_id", "name", "path", safe_url(F.col("url")).alias("url"), "course_code", "course_name", "doc_type",
        labelled(F.col("doc_type"), DOC_TYPE_LABELS).alias("doc_type_label"),
        exam_label(F.col("exam_type"), F.col("exam_number"), F.col("is_makeup")).alias("exam_label"),
        F.when(F.col("academic_year").isNotNull(), year_label(F.col("academic_year"))).otherwise("").alias("year_label"),
        "semester", "instructor", "has_solution", "syllabus_scope",
        (F.col("method") == "manual").alias("reviewed"),
        ((F.col("method") != "manual") & (F.col("confidence") < 0.7)).alias("uncertain"),
        F.round("score", 3).alias("score"),
    )
