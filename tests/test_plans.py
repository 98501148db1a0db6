"""Plans over audited documents: targets, carried answers, table intent from real markup."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import leafwright
from leafwright.operators import update
from leafwright.sources.corpus import identify
from tests.test_families import cell, flat

BODY = (
    "<text:h text:outline-level='3'>One</text:h><text:p>see https://x.example/a now</text:p>"
    "<text:p><text:a xlink:href='#x'/></text:p><draw:frame><draw:image xlink:href='a.png'/></draw:frame>"
    "<text:h text:outline-level='9'>Two</text:h>"
)


def corpus(spark, **docs):
    frame = spark.createDataFrame([(n.replace("_", "."), t) for n, t in docs.items()], "n string, t string")
    return identify(frame, F.col("n"), F.col("n"), F.col("t"))


@pytest.fixture(scope="module")
def before(spark):
    return leafwright.audit(corpus(spark, a_fodt=flat("text", BODY, "text").replace("<dc:title>T</dc:title>", "")))


def _old(questions):
    return questions.select("doc_id", "kind_id", "path", "fingerprint")


def test_unchanged_documents_carry_every_answer(spark, before):
    questions, _ = leafwright.plan(before)
    old = _old(questions)
    asked = {(r.kind_id, r.path) for r in questions.collect()}
    assert ("document.metadata", None) in asked and {p for _, p in asked} >= {"content/heading[1]", "content/frame[1]", "content/link[1]"}
    _, carried = leafwright.plan(before, old)
    assert [r.reason for r in carried.collect()] == [None] * len(asked)


def test_changed_and_missing_targets_are_told_apart(spark, before):
    old = _old(leafwright.plan(before)[0])
    # the level is what the answer changes; the second heading's words change, the link goes
    changed = BODY.replace("outline-level='3'", "outline-level='4'").replace("Two", "Three").replace("<text:a xlink:href='#x'/>", "")
    after = leafwright.audit(corpus(spark, a_fodt=flat("text", changed, "text").replace("<dc:title>T</dc:title>", "")))
    _, carried = leafwright.plan(after, old)
    reasons = {(r.kind_id, r.path): r.reason for r in carried.collect()}
    assert reasons["heading.level", "content/heading[1]"] is None and reasons["document.metadata", None] is None
    assert reasons["graphic.alternative", "content/frame[1]"] is None
    assert reasons["heading.level", "content/heading[2]"] == "changed"
    assert reasons["link.description", "content/link[1]"] == "unavailable"


def test_answers_about_the_document_bind(spark):
    kinds = [("document.metadata", None, None), ("heading.level", "content/heading[1]", "f"), ("heading.level", None, "f")]
    answers = spark.createDataFrame([(f"p{i}", "d", "s", *k) for i, k in enumerate(kinds)], "plan_id string, doc_id string, source_sha256 string, kind_id string, path string, fingerprint string")
    targets = spark.createDataFrame([("d", "content/heading[1]", "f")], "doc_id string, path string, fingerprint string")
    sources = spark.createDataFrame([("d", "s")], "doc_id string, sha256 string")
    got = {r.plan_id: (r.reason, r.plan_ok) for r in update.bind_answers(answers, targets, sources).collect()}
    assert got == {"p0": (None, True), "p1": (None, True), "p2": ("fingerprint", False)}
    twice = answers.filter("plan_id = 'p0'")
    assert {r.reason for r in update.bind_answers(twice.unionByName(twice), targets, sources).collect()} == {"answered twice"}


def _table(*rows, columns=""):
    return f'<table:table table:name="t">{columns}{"".join(rows)}</table:table>'


def _row(*cells, extra=""):
    return f"<table:table-row {extra}>{''.join(cells)}</table:table-row>"


def _headed(*rows):
    return f"<table:table-header-rows>{''.join(rows)}</table:table-header-rows>"


def test_tables_by_their_logical_rows(spark):
    two = '<table:table-column table:number-columns-repeated="2"/>'
    five = 'table:number-rows-repeated="5"'
    tall = 'table:number-rows-spanned="2"'
    covered = "<table:covered-table-cell/>"
    cases = {
        "once.fodt": _table(_row(cell("a"), cell("b")), columns=two),  # one row: may be layout
        "five.fodt": _table(_row(cell("a"), cell("b"), extra=five), columns=two),  # five rows
        "cross.fodt": _table(_headed(_row(cell("h", tall), cell("i"))), _row(covered, cell("2")), columns=two),
        "inside.fodt": _table(_headed(_row(cell("h", tall), cell("i")), _row(covered, cell("j"))), _row(cell("1"), cell("2")), columns=two),
        "narrow.fodt": _table(_row(cell("a"), cell("b")), _row(cell("c")), columns=two),
    }
    text = lambda body: flat("text", "<text:h text:outline-level='1'>x</text:h>" + body, "text")
    found = leafwright.audit(corpus(spark, **{n: text(b) for n, b in cases.items()}))
    rows = found.filter("rule_id LIKE 'TABLE%'").select("doc_id", "rule_id", "details").collect()
    got = {(r.doc_id, r.rule_id): r.details.get("classification") or r.details.get("reason") for r in rows}
    assert got == {
        ("once.fodt", "TABLE001"): "layout-candidate", ("five.fodt", "TABLE001"): "ambiguous",
        ("cross.fodt", "TABLE001"): "ambiguous", ("narrow.fodt", "TABLE002"): "row width",
    }


def test_questions_know_their_place(spark):
    from leafwright.plans.targets import question_context

    sheets = "".join(
        f'<table:table table:name="{name}"><table:table-row><table:table-cell><draw:frame><draw:image xlink:href="a.png"/></draw:frame></table:table-cell></table:table-row></table:table>'
        for name in ("One", "Two")
    )
    docs = corpus(spark, a_fodt=flat("text", BODY, "text"), s_fods=flat("spreadsheet", sheets, "spreadsheet"))
    got = question_context(leafwright.audit(docs), docs).collect()
    text = {r.path: (r.heading, r.excerpt) for r in got if r.doc_id == "a.fodt"}
    assert text["content/frame[1]"] == ("One", None) and text["content/heading[2]"] == ("Two", "Two")
    assert text["content/paragraph[1]"] == ("One", "see https://x.example/a now")
    assert sorted(r.sheet for r in got if r.doc_id == "s.fods" and r.kind_id == "graphic.alternative") == ["One", "Two"]


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_nearest_landmarks_by_brute_force(spark, block):
    import random

    from leafwright.operators.context import with_context

    rng = random.Random(block)
    marks = [(f"d{rng.randrange(3)}", rng.randrange(40), rng.choice("xy"), f"n{i}") for i in range(30)]
    marks = list({(d, p, k): (d, p, k, n) for d, p, k, n in marks}.values())
    asked = [(f"d{rng.randrange(4)}", rng.randrange(40), i) for i in range(60)]
    frame = with_context(
        spark.createDataFrame(asked, "doc_id string, pos long, q int"),
        spark.createDataFrame(marks, "doc_id string, pos long, kind string, name string"), ["x", "y"], block=block,
    )
    last = lambda d, p, k: max(((m[1], m[3]) for m in marks if m[0] == d and m[1] <= p and m[2] == k), default=(0, None))[1]
    got = {r.q: (r.x, r.y) for r in frame.collect()}
    assert got == {q: (last(d, p, "x"), last(d, p, "y")) for d, p, q in asked}
