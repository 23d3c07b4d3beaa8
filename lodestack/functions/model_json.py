"""Reading a language model's replies, and the JSON texts that are sent or logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import DOC_TYPES, EXAM_TYPES

ITEMS = "struct<items:array<struct<id:long,doc_type:string,exam_type:string,exam_number:string,is_makeup:string>>>"


def unfenced(reply: Column) -> Column:
    """The reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def verdicts(reply: Column, ids: Column) -> Column:
    """Valid items of a reply, array of struct(id, doc_type, exam_type, exam_number, is_makeup).

    An item needs an id that was asked about and known vocabulary; its number must be a whole number of 1..20 or
    absent, its make-up flag a boolean. Bad items fall out one by one; a reply that is no JSON has none.
    """
    items = F.from_json(unfenced(reply), ITEMS)["items"]
    number = lambda x: x["exam_number"].try_cast("int")
    right = lambda x: (
        F.array_contains(ids, x["id"])
        & x["doc_type"].isin(DOC_TYPES)
        & x["exam_type"].isin(EXAM_TYPES)
        & (x["exam_number"].isNull() | (x["exam_number"].rlike(r"^\d{1,2}$") & number(x).between(1, 20)))
        & F.coalesce(x["is_makeup"], F.lit("false")).isin("true", "false")
    )
    shaped = lambda x: F.struct(x["id"].alias("id"), x["doc_type"].alias("doc_type"), x["exam_type"].alias("exam_type"), number(x).alias("exam_number"), (F.coalesce(x["is_makeup"], F.lit("false")) == "true").alias("is_makeup"))
    return F.coalesce(F.transform(F.filter(items, lambda x: F.coalesce(right(x), F.lit(False))), shaped), F.array().cast("array<struct<id:long,doc_type:string,exam_type:string,exam_number:int,is_makeup:boolean>>"))


def picked_courses(reply: Column, known: Column) -> Column:
    """Up to three known codes of a reply like {"courses": [...]}, distinct, in order."""
    named = F.from_json(unfenced(reply), "struct<courses:array<string>>")["courses"]
    return F.coalesce(F.slice(F.array_distinct(F.filter(named, lambda c: F.array_contains(known, c))), 1, 3), F.array().cast("array<string>"))


def log_payload(**fields: Column) -> Column:
    """JSON text with keys in order and without empty fields."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
