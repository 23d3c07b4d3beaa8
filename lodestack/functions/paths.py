"""Folder paths: course, semester folder and category folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listing import or_null
from .text import normalize_alias

SEM_FIRST = r"(?i)^sem\s*(\d)\s+(\d{2})\s*-\s*(\d{2})\s*(?:\(([^)]*)\))?\s*$"
YEAR_FIRST = r"(?i)^(\d{2})\s*-\s*(\d{2})\s+sem\s*(\d)\s*(?:\(([^)]*)\))?\s*$"
SEMESTER = "struct<semester:int,year:int,instructor:string>"


def clean_instructor(text: Column) -> Column:
    return or_null(F.trim(F.regexp_replace(text, r"(?i)^\s*CS_\d+\s*-\s*", "")))


def semester_folder(folder: Column) -> Column:
    """struct(semester, year, instructor), or null if the name is no semester folder with consecutive years."""
    f = F.trim(folder)

    def read(pattern: str, sem: int, first: int) -> Column:
        part = lambda i: F.regexp_extract(f, pattern, i)
        a, b = part(first).try_cast("int"), part(first + 1).try_cast("int")
        right = f.rlike(pattern) & a.between(10, 40) & ((a + 1) % 100 == b)
        return F.when(right, F.struct(part(sem).try_cast("int").alias("semester"), (a + 2000).alias("year"), clean_instructor(part(4)).alias("instructor")))

    return F.coalesce(read(SEM_FIRST, 1, 2), read(YEAR_FIRST, 3, 1))


def path_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != "")


def parse_path(path: Column, aliases: Column) -> Column:
    """struct(course, semester, year, instructor, folders).

    The course is the first of the first two parts that ``aliases`` (normalised alias -> course) knows; the first
    semester folder below it parts off the category folders.
    """
    parts = path_parts(path)
    course_at = lambda i: F.try_element_at(aliases, normalize_alias(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))))
    first, second = course_at(0), course_at(1)
    skip = F.when(first.isNotNull(), 1).when(second.isNotNull(), 2).otherwise(0)
    below = F.slice(parts, skip + 1, F.size(parts) + 1)
    read = F.transform(below, semester_folder)
    at = F.coalesce(F.array_position(F.transform(read, lambda s: s.isNotNull()), True).cast("int"), F.lit(0))
    found = F.when(at > 0, F.get(read, at - 1))
    folders = F.slice(below, at + 1, F.size(below) + 1)
    return F.struct(
        F.coalesce(first, second).alias("course"),
        found["semester"].alias("semester"),
        found["year"].alias("year"),
        found["instructor"].alias("instructor"),
        folders.alias("folders"),
    )
