"""Long values: linear time, no stack, no special characters."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from leafwright.functions import language, text, uri
from leafwright.operators import graph, sequence
from leafwright.sources.html import shred_html

SECONDS = 10  # of wall-clock, with the start of a job; the old patterns took minutes or the executor


def _timed(frame):
    start = time.perf_counter()
    rows = frame.collect()
    assert time.perf_counter() - start < SECONDS
    return rows


def _one(spark, value):
    return spark.createDataFrame([(1, value)], "page_id long, v string")


def test_pages(spark):
    many = "<div " + " ".join(f'a{i}="x"' for i in range(50_000)) + ">t"
    assert _timed(shred_html(_one(spark, many), html="v"))[0].tag == "div"
    assert len(_timed(shred_html(_one(spark, "<p x" * 16_000 + ">"), html="v"))) == 1


@pytest.mark.parametrize(
    "value, function",
    [
        ("a" * 1_000_000, lambda c: F.size(text.addresses(c))),
        ("data:text/plain," + "a%20" * 25_000, uri.uri_problem),
        ("http://" + "u%41" * 9_000 + "@h/", uri.uri_problem),
        ("en" + "-abcde" * 17_000, lambda c: language.normalize_language(c)["problem"]),
        ("see /" + "name/" * 50_000 + "last", lambda c: uri.redact(c, {})),
        ("'" + "x''" * 30_000 + "'.A1", lambda c: F.length(c)),
    ],
)
def test_long_values(spark, value, function):
    assert len(_timed(_one(spark, value).select(function(F.col("v")).alias("x")))) == 1


def test_marks_of_private_use_are_ordinary_text(spark):
    rows = text.linkify(_one(spark, " https://a.example/x,  me@b.org"), "v").orderBy("segment").collect()
    assert "".join(r.words for r in rows) == " https://a.example/x,  me@b.org"
    assert [r.href for r in rows if r.href] == ["https://a.example/x", "mailto:me@b.org"]
    got = _one(spark, "ab /x/My File.odt").select(uri.redact(F.col("v"), {}).alias("x")).first().x
    assert got == "ab <path>/My File.odt"


def test_addresses_after_addresses(spark):
    found = _one(spark, "a@b.com_x@y.org,(c@d.ee)").select(text.addresses(F.col("v")).alias("x")).first().x
    assert found == ["a@b.com", "_x@y.org", "c@d.ee"]


def test_reach_has_no_cap(spark):
    refs = spark.createDataFrame([("d", i, i + 1) for i in range(70)], "doc_id string, node int, target int")
    roots = spark.createDataFrame([("d", 0), ("e", 5)], "doc_id string, node int")
    found = {r.doc_id: (r.n_reached, r.incomplete) for r in graph.reachable(roots, refs, 64).collect()}
    assert found == {"d": (70, True), "e": (0, False)}


def test_range_ordinal(spark):
    rows = [("k" if i % 3 else None, f"content/x[{i:05}]", i) for i in range(500)]
    frame = spark.createDataFrame(rows, "plan string, path string, n int")
    found = {(r.plan, r.path): r.place for r in sequence.range_ordinal(frame, ["plan"], ["path"], "place").collect()}
    for plan in ("k", None):
        paths = sorted(p for k, p, _ in rows if k == plan)
        assert [found[plan, p] for p in paths] == list(range(1, len(paths) + 1))
