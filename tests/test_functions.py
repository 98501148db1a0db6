"""Invariants of the text expressions over many generated values at once."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafwright.functions import identity, language, names, text, uri

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
TOKENS = st.lists(st.text("ab.,;:()[]{}/", max_size=12), min_size=1, max_size=60)
PROSE = st.lists(st.text("ab .,()@\n:/", max_size=20), min_size=1, max_size=40)


def _strip(raw: str) -> str:
    """Plain restatement of the trailing punctuation rule."""
    token = raw
    pairs = {")": "(", "]": "[", "}": "{"}
    while token and (token[-1] in ".,;:" or (token[-1] in pairs and token.count(token[-1]) > token.count(pairs[token[-1]]))):
        token = token[:-1]
    return token


@SLOW
@given(TOKENS)
def test_split_trailing_is_lossless_and_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "raw string")
    for row in frame.select("raw", text.split_trailing(F.col("raw")).alias("s")).collect():
        assert row["s"]["token"] + row["s"]["suffix"] == row["raw"]
        assert row["s"]["token"] == _strip(row["raw"])


@SLOW
@given(PROSE)
def test_linkify_keeps_every_character(spark, values):
    texts = [f"{v} https://x.y/{i}). {v} me@ab.cd" if i % 2 else v for i, v in enumerate(values)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got: dict[int, str] = {}
    for row in text.linkify(frame, "body").orderBy("id", "segment").collect():
        got[row["id"]] = got.get(row["id"], "") + row["words"]
    assert got == {i: t for i, t in enumerate(texts) if t}


def test_visible_words_matches_split(spark):
    values = ["a\u00a0 b", " x\u2003y\x1c z ", "\u3000", "", "one", "a\x85b\u2028c"]
    frame = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in frame.select(text.visible_words(F.col("t"))).collect()]
    assert got == [" ".join(v.split()) for v in values]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1 Start", True), ("99 x", True), ("100 x", False), ("1.2 x", True), ("2026) x", True), ("Start 1", False), ("12", False), ("007 x", True)],
)
def test_manual_numbers(spark, raw, want):
    assert spark.range(1).select(text.is_manual_number(F.lit(raw))).first()[0] is want


def test_language_tags(spark):
    cases = {
        " en_us ": ("en-US", None), "ZH-hant-tw": ("zh-Hant-TW", None), "i-KLINGON": ("i-klingon", None), "x-ABC": ("x-abc", None),
        "sl-rozaj-rozaj": (None, "repeated"), "en-a-bb-a-cc": (None, "repeated"), "a": (None, "malformed"), "": (None, None),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: tuple(r["n"]) for r in frame.select("t", language.normalize_language(F.col("t")).alias("n")).collect()}
    assert got == cases


def test_uri_resolution_matches_the_standard_library(spark):
    base = "http://h.ex/a/b/c?x=1#f"
    hrefs = ["d", "./d", "../d", "../../../d", "/d/./e/../f", "?q", "#g", "", "//o/p", "d/", "..", ".", "g;x=1/../y", "http://k/l"]
    frame = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = {r["h"]: r["r"]["uri"] for r in frame.select("h", uri.resolve_uri(F.col("h"), F.lit(base)).alias("r")).collect()}
    for href in hrefs:
        want = urljoin(base, href) if href else base.split("#")[0]
        assert got[href] == want, href
    kept = spark.range(1).select(uri.resolve_uri(F.lit("a//b/../c?#"), F.lit("http://h/x/y")).alias("r")).first()["r"]
    assert kept["uri"] == "http://h/x/a//c?#"
    for bad in ("a b", "%zz", "1:2", "x\u00e9"):
        assert spark.range(1).select(uri.resolve_uri(F.lit(bad), F.lit(base)).alias("r")).first()["r"]["uri"] is None
    assert spark.range(1).select(uri.resolve_uri(F.lit("a"), F.lit("mailto:x")).alias("r")).first()["r"]["problem"] == "base"


def test_local_resources(spark):
    cases = {
        "Pictures/a.png": "Pictures/a.png", "./a/../b": "b", "../x": None, "/x": None, "a?b": None, "a%20b": "a b", "%2e%2e/x": None,
        "folder/": "folder", ".": ".", "http://h/x": None, "a%5Cb": None, "C:x": None, "a//b": "a//b", "%zz": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r["h"]: r["m"] for r in frame.select("h", uri.local_resource(F.col("h")).alias("m")).collect()} == cases


def test_redaction(spark):
    cases = {
        "see /home/ann/My Docs/f.odt: ok": "see <path>/f.odt: ok", "C:\\Users\\bob\\x.txt|": "<path>/x.txt|", "~/notes.md\n": "<path>/notes.md\n",
        "file:///srv/a/b.xml done": "<path>/b.xml done", "a/b/c": "a/b/c", "at /work/in|": "at <inputs>|", "/work/inside/x:": "<path>/x:",
        "../up/here.md:": "<path>/here.md:",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["r"] for r in frame.select("t", uri.redact(F.col("t"), {"inputs": "/work/in"}).alias("r")).collect()}
    assert got == cases


def test_redaction_of_a_long_text_does_not_overflow(spark):
    body = "/start " + "word " * 200_000
    size = spark.createDataFrame([(body,)], "t string").select(F.length(uri.redact(F.col("t"), {}))).first()[0]
    assert size == len(body)


def test_target_paths_round_trip(spark):
    values = ["a b", "é~*(/", "x+y%", "plain"]
    frame = spark.createDataFrame([(v,) for v in values], "n string")
    got = [r[0] for r in frame.select(identity.percent_encode(F.col("n"))).collect()]
    assert got == [quote(v, safe="") for v in values]


def test_ranges(spark):
    cases = {
        "T.A1": ("T", 1, 1, 1, 1), "$'My ''T'''.$AB$12:.C30": ("My 'T'", 12, 30, 28, 3), ".b2": (None, 2, 2, 2, 2),
        "T.A1:U.B2": None, "A1": None, "T.A0": ("T", 0, 0, 1, 1),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r["a"]: tuple(r["r"]) if r["r"] else None for r in frame.select("a", identity.parse_range(F.col("a")).alias("r")).collect()}
    assert got == cases


def test_fingerprint_ignores_only_the_unprotected(spark):
    frame = spark.createDataFrame([(1, "a", None, 5), (1, "a", None, 6), (1, "a", "", 5)], "k int, n string, o string, free int")
    prints = [r[0] for r in frame.select(identity.fingerprint(["k", "n", "o"])).collect()]
    assert prints[0] == prints[1] != prints[2]
    assert all(re.fullmatch("[0-9a-f]{16}", p) for p in prints)


def test_names(spark):
    got = spark.range(1).select(
        names.name_problem(F.lit("a/b")).alias("a"), names.name_problem(F.lit("ok")).alias("b"),
        names.unsafe_reason(F.lit("a/con.txt")).alias("c"), names.unsafe_reason(F.lit("a/b.txt")).alias("d"),
        names.safe_label(F.lit("content/p[1]")).alias("e"), names.safe_label(F.lit("x=/etc")).alias("f"),
    ).first()
    assert tuple(got) == ("forbidden character", None, "not portable", None, True, False)
