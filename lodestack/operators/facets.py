"""Filters and facet counts over the document view."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import labelled, year_label
from ..vocabulary import DOC_TYPE_LABELS, DOC_TYPES, EXAM_TYPE_LABELS, FACETS, SHOWN_EXAMS

COLUMN = {"course": "course_code", "doc_type": "doc_type", "exam_type": "exam_type", "year": "academic_year"}


@dataclass(frozen=True)
class Filters:
    """OR inside a facet, AND across; an empty facet does not filter."""

    course: frozenset[str] = frozenset()
    doc_type: frozenset[str] = frozenset()
    exam_type: frozenset[str] = frozenset()
    year: frozenset[int] = frozenset()

    def values(self, facet: str) -> frozenset:
        if facet not in FACETS:
            raise ValueError(f"unknown facet {facet}")
        return getattr(self, facet)

    def without(self, facet: str) -> Filters:
        self.values(facet)
        return replace(self, **{facet: frozenset()})

    @property
    def is_empty(self) -> bool:
        return not any(self.values(f) for f in FACETS)

    def passes(self, facet: str) -> Column:
        wanted = sorted(self.values(facet))
        return indexed(facet).isin(wanted) & indexed(facet).isNotNull() if wanted else F.lit(True)

    def predicate(self) -> Column:
        out = F.lit(True)
        for f in FACETS:
            if self.values(f):
                out = out & self.passes(f)
        return out


def indexed(facet: str) -> Column:
    """A document's value of a facet, or null if the facet does not index it (blank course, exams never shown)."""
    c = F.col(COLUMN[facet])
    if facet == "course":
        return F.nullif(c, F.lit(""))
    return F.when(c.isin(SHOWN_EXAMS), c) if facet == "exam_type" else c


def parse_years(values: list[str]) -> list[int]:
    """Years of 2000..2100; anything else is an error."""
    out = []
    for v in values:
        if not v.isdigit() or not 2000 <= int(v) <= 2100:
            raise ValueError(f"not a year: {v}")
        out.append(int(v))
    return out


def facet_counts(view: DataFrame, filters: Filters) -> DataFrame:
    """(facet, value, n): each facet ignores its own filter; values without documents are left out.

    One pass: every row gives its four facet values, each with the other facets' verdict.
    """
    options = []
    for f in FACETS:
        others = F.lit(True)
        for g in FACETS:
            if g != f:
                others = others & F.coalesce(filters.passes(g), F.lit(False))
        options.append(F.struct(F.lit(f).alias("facet"), indexed(f).cast("string").alias("value"), others.alias("ok")))
    rows = view.select(F.explode(F.array(*options)).alias("o")).select("o.*").where("ok and value is not null")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def option_label(facet: Column, value: Column, course_label: Column) -> Column:
    return (
        F.when(facet == "course", course_label)
        .when(facet == "doc_type", labelled(value, DOC_TYPE_LABELS))
        .when(facet == "exam_type", labelled(value, EXAM_TYPE_LABELS))
        .otherwise(year_label(value.try_cast("int")))
    )


def ordered_options(counts: DataFrame, courses: DataFrame) -> DataFrame:
    """(facet, value, n, label, position): years newest first, exams and types in their fixed order, courses by label.

    courses: (course_code, course_name). The options of a facet are a vocabulary, not the documents.
    """
    from pyspark.sql.window import Window

    course = F.when(F.coalesce("course_name", F.lit("")) != "", F.concat_ws(" · ", "course_code", "course_name")).otherwise(F.col("value"))
    named = counts.join(courses, (counts["facet"] == "course") & (counts["value"] == courses["course_code"]), "left").withColumn("label", option_label(F.col("facet"), F.col("value"), course))
    place = lambda order: F.when(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("value")) > 0, F.array_position(F.array(*[F.lit(x) for x in order]), F.col("value"))).otherwise(len(order) + 1)
    key = F.when(F.col("facet") == "year", -F.col("value").try_cast("long")).when(F.col("facet") == "exam_type", place(SHOWN_EXAMS)).when(F.col("facet") == "doc_type", place(DOC_TYPES)).otherwise(F.lit(0))
    w = Window.partitionBy("facet").orderBy(key, F.when(F.col("facet") == "course", F.col("label")), "value")
    return named.withColumn("position", F.row_number().over(w)).select("facet", "value", "n", "label", "position")


def years_for(view: DataFrame, courses: list[str], doc_types: list[str], exams: list[str]) -> DataFrame:
    """Distinct years of the matching documents, newest first."""
    wanted = Filters(frozenset(courses), frozenset(doc_types), frozenset(exams)).predicate()
    return view.where(wanted & F.col("academic_year").isNotNull()).select("academic_year").distinct().orderBy(F.desc("academic_year"))


def course_codes(view: DataFrame) -> DataFrame:
    return view.where("course_code <> ''").select("course_code").distinct().orderBy("course_code")
