"""Text, listing, path and identity expressions against golden values."""

import base64
import datetime
import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import identity, listing, model_json, paths, text


def values(spark, column, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r["v"] for r in sorted(df.select("k", column(F.col("x")).alias("v")).collect(), key=lambda r: r["k"])]


TOKENS = [
    ("Lecture06 Slides.PDF", ["lecture", "6", "slide", "pdf"]),
    ("The History of the Class", ["history", "class"]),
    ("0007 000 a1", ["7", "0", "a1"]),
    ("Übung straße naïve", ["ubung", "strasse", "naive"]),
    ("abc12 abcd12 gas bus boss buses", ["abc12", "abcd", "12", "gas", "bus", "boss", "buse"]),
    ("", []),
    (None, []),
]


def test_tokens(spark):
    assert values(spark, text.tokens, [a for a, _ in TOKENS]) == [b for _, b in TOKENS]
    assert [text.tokenize(a or "") for a, _ in TOKENS] == [b for _, b in TOKENS]
    assert values(spark, lambda x: text.tokens(x, stem=False), ["slides"]) == [["slides"]]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abSs19 .-äÉß\n"), max_size=30), min_size=60, max_size=60))
def test_native_tokens_agree_with_the_general_rule(spark, texts):
    assert values(spark, text.tokens, texts) == values(spark, lambda x: text.tokens_any(x), texts)


def test_scalars(spark):
    assert values(spark, text.normalize_alias, ["O.O.P-2", "--"]) == ["oop2", ""]
    assert values(spark, text.normalize_name, ["A_b-(c)  [d].e"]) == ["a b c d e"]
    assert values(spark, text.text_quality, ["Good words, 12:30!", "x9$ ﾊﾟ ok", "", None]) == [1.0, pytest.approx(1 / 3), 0.0, 0.0]
    assert values(spark, text.formula_safe, ["=1", "-x", "a=1"]) == ["'=1", "'-x", "a=1"]
    assert values(spark, lambda x: text.year_label(x.cast("int")), ["2023", "2099"]) == ["2023-24", "2099-00"]
    assert values(spark, text.non_space_chars, ["a b c\n"]) == [3]
    assert values(spark, lambda x: text.matched_terms("slides of graphs", text.tokens(x)), ["Slide 3", "graph"]) == [["slides"], ["graphs"]]


def test_listing(spark):
    urls = ["https://a/file/d/Ab_1-c/view", "https://a/folders/F2", "https://a/open?x=1&id=Z9", "https://a/none"]
    assert values(spark, listing.drive_file_id, urls) == ["Ab_1-c", "F2", "Z9", None]
    assert values(spark, listing.folder_id_from, [" abc_1 ", urls[1], "not an id"]) == ["abc_1", "F2", None]
    assert values(spark, listing.file_extension, ["Mid QP.PDF", ".DS_Store", "none", "a.tar.gz", "dot."]) == ["pdf", "", "", "gz", ""]
    dates = values(spark, listing.modified_date, ["12/4/2025", "2/30/2024", "", "13/1/2024"])
    assert dates == [datetime.date(2025, 12, 4), None, None, None]
    assert values(spark, listing.safe_url, ["HTTPS://x", "javascript:x"]) == ["HTTPS://x", ""]
    assert values(spark, lambda x: listing.is_indexable(x, F.lit(""), F.lit("/a/ Images/b")), ["png", "pdf", "zip"]) == [False, True, False]
    assert values(spark, lambda x: listing.title(x, F.lit("pdf")), ["my_file  1.PDF", "__.pdf"]) == ["my file 1", "__.pdf"]


def test_semester_folders(spark):
    got = values(spark, paths.semester_folder, ["Sem 1 25-26 (CS_24 - A. Rao)", "23-24 sem2", "Sem 1 25-27", "Sem 1 05-06", "notes"])
    assert [tuple(g) if g else None for g in got] == [(1, 2025, "A. Rao"), (2, 2023, None), None, None, None]


def test_parse_path(spark):
    aliases = F.create_map(F.lit("oop"), F.lit(7))
    got = values(spark, lambda x: paths.parse_path(x, aliases), ["/Group 1/O.O.P/Sem 1 21-22 (X)/Mid/Sem 2 22-23", "/OOP/Notes", "/zzz/a", "", None])
    assert [(g["course"], g["year"], g["folders"]) for g in got] == [(7, 2021, ["Mid", "Sem 2 22-23"]), (7, None, ["Notes"]), (None, None, ["zzz", "a"]), (None, None, []), (None, None, [])]


def test_sign_in(spark):
    secret = "k" * 70
    assert values(spark, lambda x: identity.user_hash(secret, x), [" A@b.C "]) == [hmac.new(secret.encode(), b"a@b.c", hashlib.sha256).hexdigest()[:16]]
    verifier = "verifier-1"
    assert values(spark, identity.pkce_challenge, [verifier]) == [base64.urlsafe_b64encode(hashlib.sha256(verifier.encode()).digest()).decode().rstrip("=")]
    claims = {"iss": "me", "aud": ["x", "y"], "exp": 100, "nonce": "n", "email": "a@b", "email_verified": True}
    token = "h." + base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=") + ".s"
    hold = lambda x: identity.claims_hold(identity.decode_claims(x), ["me"], "y", "n", F.lit(150))
    assert values(spark, hold, [token, "junk"]) == [True, False]
    assert values(spark, lambda x: identity.is_allowed(x, F.lit("uni.edu"), ["uni.edu"], ["z@q.org"]), ["a@uni.edu", " Z@Q.org", "a@evil.edu", "uni.edu"]) == [True, True, False, False]


def test_model_replies(spark):
    good = '```json\n{"items":[{"id":1,"doc_type":"pyq","exam_type":"quiz","exam_number":3,"is_makeup":true},{"id":1,"doc_type":"nope","exam_type":"quiz"},{"id":9,"doc_type":"pyq","exam_type":"quiz"},{"id":1,"doc_type":"pyq","exam_type":"quiz","exam_number":true}]}\n```'
    got = values(spark, lambda x: model_json.verdicts(x, F.array(F.lit(1).cast("long"))), [good, "no json", None])
    assert [[(v["id"], v["exam_number"], v["is_makeup"]) for v in g] for g in got] == [[(1, 3, True)], [], []]
    assert values(spark, lambda x: model_json.picked_courses(x, F.array(F.lit("A"), F.lit("B"))), ['{"courses":["A","A","Q","B"]}', "x"]) == [["A", "B"], []]
