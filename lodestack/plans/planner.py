"""A confirmed form to a plan of searches: papers and other material, paired solutions, what could not be read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stacks
from ..operators.catalog import MAX_HITS, Catalog
from ..operators.facets import Filters
from ..scratch import staged
from ..vocabulary import DEFAULT_MATERIALS, MATERIAL_TYPES, NUMBERED_EXAMS, PAPER_MATERIALS
from .chat import Form

RELATED = {"quiz": "test", "test": "quiz"}


def paired_solutions(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Solutions among the candidates that belong to the exam of a matched paper and are not matched themselves.

    Year and number may be unknown on both sides, which counts as equal.
    """
    keys = ["course_code", "exam_type", "academic_year", "exam_number", "is_makeup"]
    papers = matched.where("doc_type <> 'solution'").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    found = candidates.where("doc_type = 'solution'").join(matched.select("doc_id"), "doc_id", "left_anti").join(papers, same, "left_semi")
    return found.withColumn("source", F.lit("paired")) if "source" in found.columns else found


def other_half_dropped(hits: DataFrame, exams: set[str]) -> DataFrame:
    """For a midsem alone, material of the second half only is left out."""
    return hits.where(~F.coalesce(F.col("syllabus_scope") == "post_midsem", F.lit(False))) if exams == {"midsem"} else hits


#: Sections that one list of hits may have.
SECTIONS = 8


def in_sections(*parts: DataFrame) -> DataFrame:
    """Hit lists one after another: ``section`` tells the list, so that the order survives a shuffle.

    Lists that have sections keep their order: list k then begins at SECTIONS * k.
    """
    columns = [c for c in parts[0].columns if c != "section"]
    nested = any("section" in p.columns for p in parts)
    inner = lambda p: F.coalesce("section", F.lit(0)) if "section" in p.columns else F.lit(0)
    return reduce(DataFrame.unionByName, [p.select(*columns, (inner(p) + SECTIONS * k if nested else F.lit(k)).cast("int").alias("section")) for k, p in enumerate(parts)])


@dataclass
class Plan:
    hits: DataFrame
    stacks: DataFrame
    paper_years: list[int]


class Planner:
    """``max_hits`` bounds each search of a plan; None keeps every hit."""

    def __init__(self, catalog: Catalog, max_hits: int | None = MAX_HITS):
        self.catalog, self.max_hits = catalog, max_hits

    def papers(self, form: Form, kinds: set[str]) -> tuple[DataFrame, list[int]]:
        doc_types = sorted(t for m in kinds for t in MATERIAL_TYPES[m])
        exams = set(form.exam_types) | {RELATED[e] for e in form.exam_types if e in RELATED}
        years = set(form.years)
        if form.recent_years:
            newest = self.catalog.years_for(list(form.courses), doc_types, sorted(exams)).limit(form.recent_years)
            years |= {r[0] for r in newest.collect()}
        filters = Filters(frozenset(form.courses), frozenset(doc_types), frozenset(exams), frozenset(years))
        # hit lists are asked for several times
        found = staged(self.catalog.search("", filters, self.max_hits, detect=False).hits, "found")
        if form.topics and self.catalog.has_content():
            matched, unreadable, _ = self.catalog.search_content(" ".join(form.topics), filters, self.max_hits)
            matched = staged(matched, "matched")
            paired = staged(paired_solutions(matched, found), "paired")
            unread = unreadable.join(paired.select("doc_id"), "doc_id", "left_anti")
            columns = found.columns
            found = in_sections(matched.select(columns), paired.select(columns), unread.select(columns))
        if form.quiz_number is not None and exams & set(NUMBERED_EXAMS):
            found = found.where(F.col("exam_number") == form.quiz_number)
        return found, sorted(years, reverse=True)

    def material(self, form: Form, kinds: set[str], with_years: bool) -> DataFrame:
        doc_types = frozenset(t for m in kinds for t in MATERIAL_TYPES[m])
        filters = Filters(frozenset(form.courses), doc_types, frozenset(), frozenset(form.years) if with_years else frozenset())
        topic = " ".join(form.topics)
        found = staged(self.catalog.search(topic, filters, self.max_hits, detect=False).hits, "found")
        if form.topics:
            if self.catalog.has_content():
                inside = self.catalog.search_content(topic, filters, self.max_hits)[0].join(found.select("doc_id"), "doc_id", "left_anti")
                found = staged(in_sections(found, inside.select(found.columns)), "found")
            if found.isEmpty():
                found = self.catalog.search("", filters, self.max_hits, detect=False).hits
        return other_half_dropped(found, set(form.exam_types))

    def run(self, form: Form) -> Plan:
        kinds = set(form.materials or DEFAULT_MATERIALS)
        papers, others = kinds & set(PAPER_MATERIALS), kinds - set(PAPER_MATERIALS)
        years: list[int] = []
        hits = None
        if papers:
            hits, years = self.papers(form, papers)
        if others:
            more = self.material(form, others, with_years=not papers)
            hits = more if hits is None else in_sections(hits, more)
        if "section" not in hits.columns:
            hits = in_sections(hits)
        return Plan(hits, stacks.stacks(hits), years)
