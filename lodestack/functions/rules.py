"""Metadata from names and folders: every rule is one column expression.

``name`` is the normalised stem, ``folders`` the lower-cased category folders, outermost first. The patterns and
confidences below are fixed values: results depend on them as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing import stem as stem_of
from .listing import title as title_of
from .paths import parse_path
from .text import normalize_name

NAME, FOLDER, PATTERN, CONFLICT = 0.95, 0.85, 0.9, 0.55

LAB_COMPRE = r"lab ?compre"
LAB_QUIZ = r"lab ?(?:quiz|test)"
COMPRE = r"compre"
MIDSEM = r"mid ?(?:sem|term|test|exam)"
QUIZ = r"quiz"
TEST = r"(?:^|\s)test ?\d|^t\d(?!\d)"
NUMBERS = [r"(?:quiz|test) ?\D{0,4}?(\d{1,2})(?!\d)", r"^t(\d)(?!\d)", r"\blq ?(\d{1,2})(?!\d)", r"\bq ?(\d{1,2})(?!\d)"]
MAKEUP = r"make ?up|\bre ?(?:mid|compre|quiz|test)"
STRONG_SOLUTION = r"soln|answer ?key|\bans\b|\banswers\b|\bsol\b"
WEAK_SOLUTION = r"solutions?(?! of\b)"
EXAM_KEY = r"\bkey\b"
WITH_SOLUTION = r"\bwith (?:the )?(?:answer ?key|solutions?|answers?|soln)"
GRADES = r"av details|average|\bmarks\b|marks distribution|hist\b|distribution|results?\b"
HANDOUT = r"handout"
CHEAT = r"cheat ?sheet|formula ?sheet"
ASSIGNMENT = r"homework|\bhw\b|assignment"
TUTORIAL = r"tutorial|\btuts?\b|problem ?sheet"
SLIDES_NAME = r"slides?|lect(?:ure)? ?\d|^lec ?\d"
NOTES_NAME = r"notes|guide"
IN_GRADES = r"insights|marks distribution"
IN_CHEAT = r"cheat ?sheets?"
IN_TEXTBOOK = r"^textbooks?$"
IN_SOLUTION = r"^(?:hw ?)?(?:soln|solutions?)$"
IN_WITH_SOLUTION = r"with solutions?"
IN_ASSIGNMENT = r"homework|^hw\b|assignment"
IN_TUTORIAL = r"tutorials?|^tuts$|problem sheets?"
IN_LAB = r"^labs?\b|\blabs?$"
IN_SLIDES = r"^slides?\b|^lecture slides"
IN_NOTES = r"notes|guides?$|bootcamp"
IN_PAST = r"past|archive|old"
PRE_MID = r"pre[\s_-]*mid"
POST_MID = r"post[\s_-]*mid"
IN_EXAMS = [
    (r"lab ?compre", "lab_compre"),
    (r"^lab ?(?:quiz|tests?)", "lab_quiz"),
    (r"^(?:re-? ?)?mid ?(?:sem|term)", "midsem"),
    (r"^(?:re-? ?)?compre", "compre"),
    (r"^quiz", "quiz"),
    (r"^tests?\b", "test"),
]
STUDENT_ID = r"(?i)20\d{2}[a-z]\d[a-z]{2}\d{4}[a-z]"
EXAM_RELEVANT = ["pyq", "solution", "grade_stats", "cheatsheet", "unknown"]
EXAM_PREFERENCE = ["lab_quiz", "quiz", "test", "midsem", "compre"]


def any_folder(folders: Column, pattern: str) -> Column:
    return F.exists(folders, lambda f: f.rlike(pattern))


def exam_keywords(name: Column) -> Column:
    """Distinct exams that the name mentions; a lab exam hides its plain namesake."""
    return F.array_compact(
        F.array(
            F.when(name.rlike(LAB_COMPRE), "lab_compre").when(name.rlike(COMPRE), "compre"),
            F.when(name.rlike(LAB_QUIZ), "lab_quiz"),
            F.when(~name.rlike(LAB_QUIZ) & name.rlike(QUIZ), "quiz"),
            F.when(~name.rlike(LAB_QUIZ) & name.rlike(TEST), "test"),
            F.when(name.rlike(MIDSEM), "midsem"),
        )
    )


def exam_of_folder(folder: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, exam in reversed(IN_EXAMS):
        out = F.when(folder.rlike(pattern), exam).otherwise(out)
    return out


def exam_from_folders(folders: Column) -> Column:
    """The exam of the deepest folder that names one; a slides or notes folder met before it means none."""
    stop = lambda f: F.when(f.rlike(IN_SLIDES) | f.rlike(IN_NOTES), "")
    verdicts = F.array_compact(F.transform(F.reverse(folders), lambda f: F.coalesce(exam_of_folder(f), stop(f))))
    return F.nullif(F.get(verdicts, F.lit(0)), F.lit(""))


def coursework_name(name: Column) -> Column:
    return name.rlike(TUTORIAL) | name.rlike(ASSIGNMENT)


def is_coursework(name: Column, folders: Column) -> Column:
    return coursework_name(name) | any_folder(folders, IN_TUTORIAL) | any_folder(folders, IN_ASSIGNMENT) | any_folder(folders, IN_LAB)


def has_exam(name: Column, folders: Column) -> Column:
    return (F.size(exam_keywords(name)) > 0) | exam_from_folders(folders).isNotNull()


def solution_in_name(name: Column, folders: Column) -> Column:
    exam = has_exam(name, folders)
    topic = any_folder(folders, IN_SLIDES) | any_folder(folders, IN_NOTES)
    strong = name.rlike(STRONG_SOLUTION) | (exam & name.rlike(EXAM_KEY))
    return ~name.rlike(WITH_SOLUTION) & (strong | (name.rlike(WEAK_SOLUTION) & (exam | ~topic)))


def has_solution(name: Column, folders: Column) -> Column:
    return name.rlike(WITH_SOLUTION) | solution_in_name(name, folders) | any_folder(folders, IN_SOLUTION) | any_folder(folders, IN_WITH_SOLUTION)


def doc_type(name: Column, folders: Column) -> Column:
    """struct(doc_type, confidence, reason): the first rule that matches."""
    solved, lab = solution_in_name(name, folders), any_folder(folders, IN_LAB)
    solution = (any_folder(folders, IN_SOLUTION) & ~lab) | (solved & (has_exam(name, folders) | ~coursework_name(name)))
    cascade = [
        (any_folder(folders, IN_GRADES) | name.rlike(GRADES), "grade_stats", NAME, "marks / grade statistics"),
        (name.rlike(HANDOUT), "handout", NAME, "name says handout"),
        (name.rlike(CHEAT) | any_folder(folders, IN_CHEAT), "cheatsheet", PATTERN, "cheat sheet"),
        (any_folder(folders, IN_TEXTBOOK), "textbook", FOLDER, "textbook folder"),
        (solution, "solution", PATTERN, "solution keyword"),
        (F.size(exam_keywords(name)) > 0, "pyq", NAME, "exam keyword in name"),
        (exam_from_folders(folders).isNotNull(), "pyq", FOLDER, "exam folder"),
        (name.rlike(ASSIGNMENT) | any_folder(folders, IN_ASSIGNMENT), "assignment", FOLDER, "homework / assignment"),
        (name.rlike(TUTORIAL) | any_folder(folders, IN_TUTORIAL), "tutorial", FOLDER, "tutorial / problem sheet"),
        (solved, "solution", FOLDER, "solution keyword"),
        (lab, "lab", FOLDER, "lab folder"),
        (any_folder(folders, IN_SLIDES), "slides", FOLDER, "slides folder"),
        (any_folder(folders, IN_NOTES) | name.rlike(NOTES_NAME), "notes", FOLDER, "notes / guide"),
        (name.rlike(SLIDES_NAME), "slides", 0.75, "lecture-style file name"),
    ]
    verdict = lambda t, c, r: F.struct(F.lit(t).alias("doc_type"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    out = verdict("unknown", 0.0, "no rule matched")
    for test, *rest in reversed(cascade):
        out = F.when(test, verdict(*rest)).otherwise(out)
    return out


def exam_type(name: Column, folders: Column) -> Column:
    """struct(exam, confidence, note): the name first, the folders second."""
    found, folder = exam_keywords(name), exam_from_folders(folders)
    verdict = lambda e, c, n: F.struct(e.alias("exam"), F.lit(c).alias("confidence"), F.lit(n).alias("note"))
    preferred = F.coalesce(*[F.when(F.array_contains(found, e), e) for e in EXAM_PREFERENCE])
    return (
        F.when(F.size(found) == 1, verdict(F.get(found, F.lit(0)), NAME, ""))
        .when((F.size(found) > 1) & F.coalesce(F.array_contains(found, folder), F.lit(False)), verdict(folder, FOLDER, "name mentions two exams; folder decides"))
        .when((F.size(found) > 1) & preferred.isNotNull(), verdict(preferred, CONFLICT, "name mentions more than one exam"))
        .when(folder.isNotNull(), verdict(folder, FOLDER, ""))
        .otherwise(verdict(F.lit("unknown"), 0.0, "no exam keyword in name or folders"))
    )


def exam_number(name: Column, folders: Column) -> Column:
    """The number behind an exam word of the name, else at the end of the deepest exam folder."""
    number = lambda text, pattern: F.regexp_extract(text, pattern, 1).try_cast("int")
    deepest = F.get(F.filter(F.reverse(folders), lambda f: exam_of_folder(f).isNotNull()), F.lit(0))
    return F.coalesce(*[number(name, p) for p in NUMBERS], number(F.trim(deepest), r"(\d{1,2})$"))


def scope(folders: Column) -> Column:
    """pre_midsem or post_midsem by the outermost folder that says so."""
    each = F.transform(folders, lambda f: F.when(f.rlike(PRE_MID), "pre_midsem").when(f.rlike(POST_MID), "post_midsem"))
    return F.get(F.array_compact(each), F.lit(0))


def is_makeup(name: Column, folders: Column) -> Column:
    return name.rlike(MAKEUP) | F.exists(folders, lambda f: normalize_name(f).rlike(MAKEUP))


#: What stands before a number that is no year, and the forms of a year; the flag: any match counts, not
#: the first alone.
RANGE_WORD = r"(?i)(?:lect(?:ure)?s?|lec|week|chapter|ch|unit|tut(?:orial)?|sheet|hw|problem|part|set|q)[\s_-]*$"
SPANS = [
    (r"(?<!\d)(\d{2}) ?[-_/] ?(\d{2})(?!\d)", True),
    (r"(?<!\d)20(\d{2})[\s_]+(\d{2})(?!\d)", False),
    (r"(?<!\d)(\d{2})(\d{2})(?!\d)", True),
]
SINGLE_YEAR = r"(?<!\d)(20\d{2})(?!\d)"


def year_from_name(stem: Column) -> Column:
    """struct(year, is_span) of a stem: the first span of two following years, by form, else a lone year.

    A number behind a range word ("lecture 16-17") is no year; it still uses up its characters, so each form's matches
    are listed with the text before them, and filtered.
    """
    verdict = lambda y, span: F.struct(y.cast("int").alias("year"), F.lit(span).alias("is_span"))

    def listed(form: str, groups: int) -> Column:
        """The form's matches in order: struct(lead, g1, ...)."""
        found = [F.regexp_extract_all(stem, F.lit(form), F.lit(g + 1)) for g in range(groups)]
        return F.arrays_zip(F.slice(F.split(stem, form, -1), 1, F.size(found[0])).alias("lead"), *[x.alias(f"g{k}") for k, x in enumerate(found)])

    def real(m: Column) -> Column:
        first, then = m["g0"].cast("int"), m["g1"].cast("int")
        return first.between(10, 40) & ((first + 1) % 100 == then) & ~m["lead"].rlike(RANGE_WORD)

    found = []
    for form, any_match in SPANS:
        every = listed(form, 2)
        found.append(F.get(F.filter(every if any_match else F.slice(every, 1, 1), real), F.lit(0))["g0"])
    year = F.coalesce(*found)
    lone = F.get(listed(SINGLE_YEAR, 1), F.lit(0))
    usable = F.coalesce(~stem.rlike(STUDENT_ID), F.lit(False))
    none = verdict(F.lit(None), False)
    return F.when(~usable, none).when(year.isNotNull(), verdict(year.cast("int") + 2000, True)).when(lone.isNotNull() & ~lone["lead"].rlike(RANGE_WORD), verdict(lone["g0"], False)).otherwise(none)


def academic_year(folder_year: Column, folders: Column, named: Column) -> Column:
    """struct(year, note). Inside an archive folder, or without a folder year, only the name can tell; elsewhere the
    folder's year stands, and a name that disagrees is noted (a lone year may be the next calendar year)."""
    year, span = named["year"], F.coalesce(named["is_span"], F.lit(False))
    archived = any_folder(folders, IN_PAST)
    verdict = lambda y, n: F.struct(y.cast("int").alias("year"), n.alias("note"))
    weak = F.when(span, "").otherwise("year taken from a lone year in the file name")
    missing = F.when(folder_year.isNull(), "no academic year found").otherwise("inside a past-material folder; year unknown")
    agrees = year.isNull() | (year == folder_year) | (~span & (year == folder_year + 1))
    return F.when(folder_year.isNull() | archived, verdict(year, F.when(year.isNull(), missing).otherwise(weak))).otherwise(
        verdict(folder_year, F.when(agrees, "").otherwise("year in the file name differs from its folder"))
    )


def extract(files: DataFrame, aliases: Column) -> DataFrame:
    """files (path, name, extension, ...) with everything the rules can say about each file.

    Adds course, academic_year, semester, instructor, exam_type, exam_number, doc_type, is_makeup, has_solution,
    syllabus_scope, title, confidence, method, notes. Nothing is shuffled; null paths and names count as empty.
    """
    name_col, ext = F.coalesce("name", F.lit("")), F.coalesce("extension", F.lit(""))
    base = files.withColumn("_path", parse_path(F.col("path"), aliases)).withColumn("_stem", stem_of(name_col, ext))
    base = base.withColumn("_name", normalize_name(F.col("_stem"))).withColumn("_folders", F.transform("_path.folders", lambda f: F.lower(F.trim(f))))
    name, folders = F.col("_name"), F.col("_folders")
    base = base.withColumn("_doc", doc_type(name, folders)).withColumn("_exam", exam_type(name, folders)).withColumn("_named", year_from_name(F.col("_stem")))
    kind = F.col("_doc.doc_type")
    unneeded = kind.isin("grade_stats", "cheatsheet") | is_coursework(name, folders)
    none = (F.col("_exam.exam") == "unknown") & unneeded
    exam = F.when(~kind.isin(EXAM_RELEVANT) | none, "none").otherwise(F.col("_exam.exam"))
    exam_note = F.when(kind.isin(EXAM_RELEVANT) & ~none, F.col("_exam.note")).otherwise("")
    year = academic_year(F.col("_path.year"), folders, F.col("_named"))
    student = F.col("_stem").rlike(STUDENT_ID)
    lower = lambda c, bound: F.when(c, bound).otherwise(1.0)
    confidence = F.least(
        F.col("_doc.confidence"),
        F.when(kind.isin("pyq", "solution", "unknown"), F.when(none, F.col("_doc.confidence")).otherwise(F.col("_exam.confidence"))).otherwise(1.0),
        lower(year["note"].contains("differs"), CONFLICT + 0.1),
        lower(student, CONFLICT),
        lower(F.col("_path.course").isNull(), 0.0),
    )
    notes = F.array(
        F.col("_doc.reason"),
        exam_note,
        year["note"],
        F.when(student, "file name is a student id; confirm it should be shown").otherwise(""),
        F.when(F.col("_path.course").isNull(), "course folder not recognised").otherwise(""),
    )
    numbered = exam.isin("quiz", "test", "lab_quiz")
    return base.select(
        *[F.col(c) for c in files.columns],
        F.col("_path.course").alias("course"),
        year["year"].alias("academic_year"),
        F.col("_path.semester").alias("semester"),
        F.col("_path.instructor").alias("instructor"),
        exam.alias("exam_type"),
        F.when(numbered, exam_number(name, folders)).alias("exam_number"),
        kind.alias("doc_type"),
        is_makeup(name, folders).alias("is_makeup"),
        has_solution(name, folders).alias("has_solution"),
        scope(folders).alias("syllabus_scope"),
        title_of(name_col, ext).alias("title"),
        F.round(confidence, 2).alias("confidence"),
        F.lit("rule").alias("method"),
        F.filter(notes, lambda n: n != "").alias("notes"),
    )


def needs_llm(kind: Column, exam: Column) -> Column:
    return (kind == "unknown") | (kind.isin("pyq", "solution") & (exam == "unknown"))


def review_reasons(course: Column, kind: Column, exam: Column, year: Column, method: Column, confidence: Column, notes: Column) -> Column:
    """Why a person should look at the file; notes join in below a confidence of 0.7."""
    paper = kind.isin("pyq", "solution")
    found = F.array_compact(
        F.array(
            F.when(course.isNull(), "course not recognised"),
            F.when(kind == "unknown", "document type unknown"),
            F.when(paper & (exam == "unknown"), "exam type unknown"),
            F.when(paper & year.isNull(), "academic year unknown"),
            F.when(method == "llm", "suggested by the language model; please confirm"),
        )
    )
    return F.when(confidence < 0.7, F.array_union(found, notes)).otherwise(found)


def apply_verdict(metadata: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rule metadata with a model's verdicts (key, v_doc_type, v_exam_type, v_exam_number, v_is_makeup) in its gaps.

    The model never overwrites: it fills unknowns, a missing number of a numbered exam, or adds a make-up flag. Rows
    without verdict, or that it adds nothing to, stay as they are. verdicts must have one row for each key.
    """
    both = metadata.join(verdicts, key, "left")
    has = F.col("v_doc_type").isNotNull()
    kind = F.when(has & (F.col("doc_type") == "unknown"), F.col("v_doc_type")).otherwise(F.col("doc_type"))
    both = both.withColumn("_kind", kind)
    exam = F.when(has & (F.col("exam_type") == "unknown"), F.col("v_exam_type")).otherwise(F.col("exam_type"))
    exam = F.when(has & ~F.col("_kind").isin(EXAM_RELEVANT) & (exam == "unknown"), "none").otherwise(exam)
    both = both.withColumn("_exam", exam)
    number = F.when(has & F.col("exam_number").isNull() & F.col("_exam").isin("quiz", "test", "lab_quiz"), F.col("v_exam_number")).otherwise(F.col("exam_number"))
    makeup = F.col("is_makeup") | (has & F.coalesce("v_is_makeup", F.lit(False)))
    both = both.withColumn("_number", number).withColumn("_makeup", makeup)
    changed = (F.col("_kind") != F.col("doc_type")) | (F.col("_exam") != F.col("exam_type")) | ~F.col("_number").eqNullSafe(F.col("exam_number")) | (F.col("_makeup") != F.col("is_makeup"))
    new = {
        "doc_type": F.col("_kind"),
        "exam_type": F.col("_exam"),
        "exam_number": F.col("_number"),
        "is_makeup": F.col("_makeup"),
        "confidence": F.when(changed, 0.65).otherwise(F.col("confidence")),
        "method": F.when(changed, "llm").otherwise(F.col("method")),
        "notes": F.when(changed, F.concat("notes", F.array(F.lit("filled in by the language model")))).otherwise(F.col("notes")),
    }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in metadata.columns])
