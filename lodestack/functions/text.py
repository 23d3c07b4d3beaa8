"""Text expressions: folding, tokens, aliases, readability. All built-in functions unless the name ends in _any."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocabulary import STOPWORDS


FAR = 0x250


def _fold(ch: str) -> str:
    plain = unicodedata.normalize("NFKD", ch).casefold()
    return "".join(c for c in plain if not unicodedata.combining(c))


@cache
def folds() -> tuple[dict[str, str], dict[str, str], str]:
    """(characters that fold to one ASCII letter or digit, those that fold to several characters with one among them,
    a pattern of those that fold to nothing), over all of Unicode."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    gone: list[int] = []
    for i in range(0x80, 0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        plain = _fold(chr(i))
        if not plain:
            gone.append(i)
        elif len(plain) == 1:
            if plain.isascii() and plain.isalnum():
                single[chr(i)] = plain
        elif any(c.isascii() and c.isalnum() for c in plain):
            several[chr(i)] = plain
    return single, several, _class(gone)


def _class(points: list[int]) -> str:
    """A regular expression for any of the code points, as ranges. Those from FAR on stand behind a look that letters
    of European texts fail at once, because a class of many ranges is slow."""

    def ranges(some: list[int]) -> str:
        out, start = [], None
        for k, i in enumerate(some):
            start = i if start is None else start
            if k + 1 == len(some) or some[k + 1] != i + 1:
                out.append(rf"\x{{{start:X}}}-\x{{{i:X}}}")
                start = None
        return "[" + "".join(out) + "]"

    near, far = [i for i in points if i < FAR], [i for i in points if i >= FAR]
    parts = [ranges(near)] * bool(near) + [rf"(?=[^\x{{0}}-\x{{{FAR - 1:X}}}]){ranges(far)}"] * bool(far)
    return "(?:" + "|".join(parts) + ")"


@cache
def fold_table() -> tuple[str, str]:
    single = folds()[0]
    return "".join(single), "".join(single.values())


def fold(text: Column) -> Column:
    """Lower case without accents, as ``tokenize`` does it. ASCII texts skip the tables, and the few characters that
    fold to several are looked up one by one where there are any."""
    _, several, gone = folds()
    pattern = _class(sorted(map(ord, several)))
    plain = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spelt = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.try_element_at(plain, c))
    pieces = F.zip_with(F.split(text, pattern, -1), F.concat(spelt, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    whole = F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)
    out = F.regexp_replace(F.translate(whole, *fold_table()), gone + "+", "")
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text))


def tokens(text: Column, stem: bool = True) -> Column:
    """Tokens in order, repeats kept; null text has none.

    Runs of letters and digits, four letters or more parted from digits behind them, stop words dropped, leading
    zeros stripped, and with ``stem`` the plural s of words of four letters or more (not ss).
    """
    parted = F.regexp_replace(fold(text), "(?<![a-z0-9])([a-z]{4,})([0-9]+)(?![a-z0-9])", "$1 $2")
    runs = F.filter(F.regexp_extract_all(parted, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(STOPWORDS))

    def shaped(t: Column) -> Column:
        number = F.regexp_replace(t, "^0+(?=[0-9])", "")
        out = F.when(t.rlike("^[0-9]+$"), number)
        if stem:
            out = out.when(t.rlike("^[a-z]{2,}[a-rt-z]s$"), F.substring(t, F.lit(1), F.length(t) - 1))
        return out.otherwise(t)

    return F.coalesce(F.transform(runs, shaped), F.array().cast("array<string>"))


def stemmed(words: Column) -> Column:
    """tokens() with stem, from those without: the plural s of words of four letters or more goes (not ss)."""
    return F.transform(words, lambda t: F.when(t.rlike("^[a-z]{2,}[a-rt-z]s$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def tokenize(text: str, stem: bool = True) -> list[str]:
    """The same rules in Python, for one query text on the driver and for any script."""
    out = []
    for run in re.findall(r"[a-z0-9]+", _fold(text)):
        parted = re.fullmatch(r"([a-z]{4,})([0-9]+)", run)
        for t in parted.groups() if parted else (run,):
            if t in STOPWORDS:
                continue
            if t.isdigit():
                t = t.lstrip("0") or "0"
            elif stem and re.fullmatch(r"[a-z]{2,}[a-rt-z]s", t):
                t = t[:-1]
            out.append(t)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_any(text: pd.Series) -> pd.Series:
    """Tokens of texts in any script (full Unicode decomposition), Arrow batches."""
    return text.map(lambda t: tokenize(t or ""))


def normalize_alias(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def normalize_name(text: Column) -> Column:
    """Lower case; separators become single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[_\-+()\[\]#.,]+", " "), r"\s+", " "))


def matched_terms(query: str, doc_tokens: Column) -> Column:
    """Query words, distinct and in order, one of whose stems is among the document's tokens."""
    words = list(dict.fromkeys(tokenize(query, stem=False)))
    found = [F.when(F.arrays_overlap(doc_tokens, F.array(*[F.lit(t) for t in tokenize(w)])), F.lit(w)) for w in words if tokenize(w)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


TRIM = ".,;:?!()[]{}\"'“”"


def text_quality(text: Column) -> Column:
    """Share of white-space tokens that look like words or numbers; 0 for empty text."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: F.btrim(t, F.lit(TRIM)))
    kept = F.filter(raw, lambda t: t != "")
    good = F.filter(kept, lambda t: t.rlike(r"^[A-Za-z][A-Za-z'’-]{0,14}$") | t.rlike(r"^[0-9.,/:%+\-=()<>]+$"))
    return F.when(F.size(kept) > 0, F.size(good) / F.size(kept)).otherwise(0.0)


def non_space_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""))


def year_label(year: Column) -> Column:
    """2023 -> 2023-24, 2099 -> 2099-00."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flat(values: Column) -> Column:
    return F.array_join(values, ",")


def formula_safe(value: Column) -> Column:
    """Cells that a spreadsheet would run get a leading apostrophe."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """The display name of a vocabulary value, or the value itself."""
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(value == k, v).otherwise(out)
    return F.coalesce(out, value)
