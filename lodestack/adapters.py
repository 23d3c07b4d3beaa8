"""The engine's tables derived from the driver's, and the same derivations in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import fold_table
from .vocabulary import DOC_TYPES, EXAM_TYPES, METHODS, STOPWORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.concat(F.lit("f"), i.cast("string")).alias("drive_file_id"), F.concat_ws("/", F.lit(""), "lang", "source").alias("path"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("name"), F.concat(F.lit("https://drive.google.com/file/d/f"), i.cast("string"), F.lit("/view")).alias("url"),
        pick(DOC_TYPES, F.floor(i / 8) % 13).alias("doc_type"), pick(EXAM_TYPES, i % 8).alias("exam_type"), F.nullif(i % 4, F.lit(0)).cast("int").alias("exam_number"),
        F.when(i % 11 != 0, 2015 + i % 10).cast("int").alias("academic_year"), (i % 17 == 0).alias("is_makeup"), (i % 5 == 0).alias("has_solution"), ((i % 21) / 20.0).alias("confidence"),
        pick(METHODS, i % 3).alias("method"), F.col("lang").alias("course_code"), F.concat(F.upper("lang"), F.lit(" studies")).alias("course_name"), (1 + i % 2).cast("int").alias("semester"),
        F.concat(F.lit("Prof "), "source").alias("instructor"), F.when(i % 3 == 0, "pre_midsem").when(i % 3 == 1, "post_midsem").alias("syllabus_scope"),
    )


def stored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """documents, raw_files, courses and review_queue as a catalogue stores them, dealt from the view."""
    v, i = document_view(spark, sf_dir), F.col("doc_id")
    course = F.when(F.col("course_code") == "en", 1).when(F.col("course_code") == "de", 2).when(F.col("course_code") == "fr", 9).cast("long")
    documents = v.select(
        i.alias("id"), (i * 2).alias("raw_file_id"), course.alias("course_id"), F.col("drive_file_id").alias("title"), "doc_type", "exam_type", "exam_number", "academic_year", "is_makeup", "has_solution", "semester", "instructor", "syllabus_scope",
        F.when(i % 19 == 0, "broken").otherwise("ok").alias("link_status"), F.col("method").alias("extraction_method"), F.when(i % 7 != 0, F.col("confidence")).alias("extraction_confidence"), F.lit("").alias("extraction_notes"), (i % 6 == 1).alias("reviewed"),
    )
    raw = v.select((i * 2).alias("id"), (i % 3).alias("source_id"), "drive_file_id", "path", "name", "url", F.when(i % 4 == 0, "png").otherwise("pdf").alias("extension"), (i % 5 != 0).alias("is_indexable"))
    courses = spark.createDataFrame([(1, "EN1", "English"), (2, "DE1", "German"), (3, "XX1", "Empty")], "id long, code string, name string")
    queue = v.select(i.alias("id"), i.alias("document_id"), F.lit("check").alias("reason"), F.when(i % 3 == 0, "resolved").otherwise("open").alias("status"))
    return {"documents": documents, "raw_files": raw, "courses": courses, "review_queue": queue}


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEW_SQL = f"""dv AS (SELECT doc_id, 'f' || doc_id AS drive_file_id, '/' || lang || '/' || source AS path, split_part(coalesce(text, ''), chr(10), 1) AS name,
 'https://drive.google.com/file/d/f' || doc_id || '/view' AS url, {sql_list(DOC_TYPES)}[(doc_id // 8) % 13 + 1] AS doc_type, {sql_list(EXAM_TYPES)}[doc_id % 8 + 1] AS exam_type,
 CAST(nullif(doc_id % 4, 0) AS INT) AS exam_number, CAST(CASE WHEN doc_id % 11 <> 0 THEN 2015 + doc_id % 10 END AS INT) AS academic_year, doc_id % 17 = 0 AS is_makeup, doc_id % 5 = 0 AS has_solution,
 (doc_id % 21) / 20.0::DOUBLE AS confidence, {sql_list(METHODS)}[doc_id % 3 + 1] AS method, lang AS course_code, upper(lang) || ' studies' AS course_name, CAST(1 + doc_id % 2 AS INT) AS semester,
 'Prof ' || source AS instructor, CASE doc_id % 3 WHEN 0 THEN 'pre_midsem' WHEN 1 THEN 'post_midsem' END AS syllabus_scope FROM documents)"""


STORED_SQL = f"""{VIEW_SQL}, sd AS (SELECT doc_id AS id, doc_id * 2 AS raw_file_id, CASE course_code WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 9 END AS course_id, drive_file_id AS title, doc_type, exam_type, exam_number, academic_year, is_makeup, has_solution, semester, instructor, syllabus_scope,
 CASE WHEN doc_id % 19 = 0 THEN 'broken' ELSE 'ok' END AS link_status, method AS extraction_method, CASE WHEN doc_id % 7 <> 0 THEN confidence END AS extraction_confidence, doc_id % 6 = 1 AS reviewed FROM dv),
sr AS (SELECT doc_id * 2 AS id, doc_id % 3 AS source_id, drive_file_id, path, name, url, CASE WHEN doc_id % 4 = 0 THEN 'png' ELSE 'pdf' END AS extension, doc_id % 5 <> 0 AS is_indexable FROM dv),
sc AS (SELECT * FROM (VALUES (1, 'EN1', 'English'), (2, 'DE1', 'German'), (3, 'XX1', 'Empty')) t(id, code, name)),
sq AS (SELECT doc_id AS id, doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM dv)"""


def sql_tokens(text: str, stem: bool = True) -> str:
    """The token rules in DuckDB SQL, written without look-around."""
    pairs = [(a, b) for a, b in zip(*fold_table()) if "À" <= a <= "ɏ"]
    source, target = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    folded = f"lower(translate(replace({text}, 'ß', 'ss'), '{source}', '{target}'))"
    split = f"flatten(list_transform(regexp_extract_all({folded}, '[a-z0-9]+'), lambda r: CASE WHEN regexp_full_match(r, '[a-z]{{4,}}[0-9]+') THEN [regexp_extract(r, '^[a-z]+'), regexp_extract(r, '[0-9]+$')] ELSE [r] END))"
    kept = f"list_filter({split}, lambda t: NOT list_contains({sql_list(STOPWORDS)}, t))"
    plural = "WHEN regexp_full_match(t, '[a-z]{2,}[a-rt-z]s') THEN left(t, len(t) - 1)" if stem else ""
    return f"list_transform({kept}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN (CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END) {plural} ELSE t END)"


#: Names and folders that meet every branch of the metadata rules, dealt over the documents.
STEMS = [
    "Quiz 2 soln", "midsem 2021-22", "Compre_paper 22-23", "lab compre 3", "Lab quiz 4", "t3", "Test 12 makeup", "re mid sem", "handout 2023", "cheat sheet", "Homework 3", "tut 5 solutions",
    "lecture 16-17", "Lec 4", "notes on series solution of ode", "quiz1 with solutions", "marks distribution", "random file", "Quiz 1 key", "2031B5QT4321Z", "midsem quiz 3", "solutions", "answers to problem sheet 2", "lq9 test",
]
FOLDERS = ["Midsem", "Quiz/Slides and notes", "Past papers", "Lab Test 1", "Labs/Soln", "Slides", "Notes", "Homework", "Tutorials", "Textbooks", "Pre Midsem/Slides", "Post_mid/Notes", "Insights", "Compre with solutions", "", "Re-mid sem"]
SEMESTERS = ["Sem 1 21-22 (CS_24 - A. Rao)", "22-23 Sem 2", "sem 2 20-22", "misc", "23-24 SEM 1 (Joshi)"]


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (doc_id, path, name, extension) whose course folder is the document's language."""
    i = F.col("doc_id")
    path = F.concat_ws("/", F.lit(""), "lang", pick(SEMESTERS, i % 5), pick(FOLDERS, F.floor(i / 3) % 16))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(pick(STEMS, i % 24), F.lit(".PDF")).alias("name"), F.lit("pdf").alias("extension"), "lang")


RULE_SQL = f"""rf AS (SELECT doc_id, lang, {sql_list(STEMS)}[doc_id % 24 + 1] AS stem, {sql_list(SEMESTERS)}[doc_id % 5 + 1] AS sem, {sql_list(FOLDERS)}[(doc_id // 3) % 16 + 1] AS folder FROM documents),
rn AS (SELECT *, trim(regexp_replace(regexp_replace(lower(stem), '[_\\-+()\\[\\]#.,]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name,
 list_filter(list_transform(string_split(folder, '/'), lambda f: lower(trim(f))), lambda f: f <> '') AS own,
 CASE WHEN sem IN ('sem 2 20-22', 'misc') THEN [lower(sem)] ELSE [] END AS odd FROM rf),
r AS (SELECT *, list_concat(odd, own) AS folders FROM rn)"""
