"""Measurement: samples, label sheets, self-queries, percentiles, corpus scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from . import index

FIELDS = ["doc_type", "exam_type", "exam_number", "academic_year", "is_makeup"]


def shuffled(key: Column, seed: int) -> Column:
    """A repeatable random order that any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def balanced_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows round-robin over the groups: an equal share of each until it runs out."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(shuffled(F.col(key), seed), key))
    return rows.withColumn("turn", place).where(F.col("turn") <= n).orderBy("turn", group, key).limit(n)


def hardest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("confidence", "path", "name", "doc_id").limit(n)


def capped_sample(rows: DataFrame, group: str, key: str, most: int, seed: int = 1) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(shuffled(F.col(key), seed), key))
    return rows.withColumn("turn", place).where(F.col("turn") <= most)


def cell(c: Column, kind: str) -> Column:
    text = F.when(c, "yes").otherwise("no") if kind == "boolean" else c.cast("string")
    return F.when(c.isNull(), "").otherwise(text)


def label_sheet(view: DataFrame, size: int = 100, hard_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Rows for a person to check: the least certain documents, and a balanced sample of the others."""
    n_hard = round(size * hard_share)
    hard = hardest(view, n_hard)
    rest = view.join(hard.select("doc_id"), "doc_id", "left_anti")
    spread = balanced_sample(rest, "doc_type", "doc_id", size - n_hard, seed).drop("turn")
    both = spread.withColumn("stratum", F.lit("spread")).unionByName(hard.withColumn("stratum", F.lit("hard")))
    kinds = dict(view.dtypes)
    return both.select("stratum", "doc_id", "course_code", "path", "name", "url", *[cell(F.col(f), kinds[f]).alias(f"pred_{f}") for f in FIELDS])


def sheet_problems(sheet: DataFrame) -> DataFrame:
    """Rows that cannot be scored: a verdict that is neither y, n nor blank, or n without a correction."""
    verdict = F.lower(F.trim(F.coalesce("correct", F.lit(""))))
    fixed = F.exists(F.array(*[F.coalesce(F.trim(F.col(f"fix_{f}")), F.lit("")) for f in FIELDS]), lambda x: x != "")
    return sheet.where(~verdict.isin("", "y", "n") | ((verdict == "n") & ~fixed))


def label_accuracy(sheet: DataFrame) -> DataFrame:
    """(stratum, field, right, total, rows, rows_correct) of the checked rows; a correction equal to the prediction is right."""
    verdict = F.lower(F.trim(F.coalesce("correct", F.lit(""))))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    checked = sheet.where(verdict.isin("y", "n"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), ((verdict == "n") & (text(f"fix_{f}") != "") & (text(f"fix_{f}") != text(f"pred_{f}"))).alias("wrong")) for f in FIELDS])
    rows = checked.select(F.coalesce("stratum", F.lit("spread")).alias("stratum"), (verdict == "y").alias("ok"), F.explode(each).alias("f"))
    return rows.groupBy("stratum", "f.field").agg(F.count_if(~F.col("f.wrong")).alias("right"), F.count("*").alias("total"), F.count("*").alias("rows"), F.count_if("ok").alias("rows_correct"))


def percentile(c: str, p: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(c, F.lit(p / 100))


def self_queries(texts: DataFrame, names: DataFrame, words: int = 3, share: float = 0.05, least_tf: int = 2, letters: int = 5) -> DataFrame:
    """(doc_id, query): the rarest repeated words of each text that its name does not have; texts with fewer are left out.

    Rare: in at most max(2, share of texts) texts. Names: (doc_id, name).
    """
    post = index.postings(texts)
    limit = F.greatest(F.lit(2), F.floor(F.col("n_docs") * share))
    n = texts.agg(F.count("*").alias("n_docs"))
    named = names.select("doc_id", F.explode_outer(F.array_distinct(tokens(F.col("name")))).alias("term")).where("term is not null")
    long = post.where((F.col("tf") >= least_tf) & F.col("term").rlike(f"^[a-z]{{{letters},}}$"))
    rare = long.join(index.doc_freq(post), "term").join(F.broadcast(n)).where(F.col("df") <= limit)  # n: one row
    rare = rare.join(named, ["doc_id", "term"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", F.desc("tf"), "term"))
    best = rare.withColumn("at", place).where(F.col("at") <= words)
    gathered = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("w")).where(F.size("w") == words)
    return gathered.select("doc_id", F.array_join(F.transform("w", lambda x: x["term"]), " ").alias("query"))


def scale_corpus(docs: DataFrame, factor: int, size: int, title: str = "title") -> DataFrame:
    """Each document ``factor`` times with its own title and id copy * size + id; factor 1 changes nothing."""
    if factor == 1:
        return docs
    copies = docs.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    new = {"doc_id": F.col("_copy") * size + F.col("doc_id"), title: F.concat(F.col(title), F.lit(" copy"), F.col("_copy").cast("string"))}
    return copies.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
