"""The ordered scans over nested structure, against plain stacks."""

from __future__ import annotations

import random
import resource
import time

import pytest
from pyspark.sql import functions as F

from leafwright.operators.nesting import match, match_in_order, with_enclosing, with_owners
from leafwright.plans.nodes import placed
from leafwright.sources.html import shred_html, with_tree
from leafwright.sources.xml import shred_xml


def _events(seed: int):
    rng = random.Random(seed)
    rows, expected = [], []
    for doc in range(12):
        stack, surplus = [], 0
        for pos in range(1, rng.randint(2, 120)):
            kind = rng.choice((1, 1, -1, -1, 0) if doc % 2 else (1, 1, 1, -1, 0))
            tag = rng.choice("abc")
            rows.append((doc, pos, tag, kind))
            top = stack[-1] if stack else (None, None)
            expected.append((doc, pos, len(stack) - surplus + 1, *top))
            if kind == 1:
                stack.append((pos, tag))
            elif kind == -1:
                if stack:
                    stack.pop()
                else:
                    surplus += 1
    return rows, sorted(expected, key=repr)


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_events_match_in_blocks(spark, block):
    rows, expected = _events(block)
    frame = spark.createDataFrame(rows, "doc long, pos long, tag string, kind int")
    columns = ["doc", "pos", "depth", "parent_pos", "parent_tag"]
    shuffled = match(frame.orderBy(F.xxhash64("pos", "doc")), "doc", "pos", "tag", F.col("kind"), block)
    assert sorted(map(tuple, shuffled.select(columns).collect()), key=repr) == expected
    in_order = match_in_order(frame.coalesce(1), "doc", "pos", "tag", F.col("kind"))
    assert sorted(map(tuple, in_order.select(columns).collect()), key=repr) == expected


def test_page_trees_need_no_exchange(spark):
    page = spark.createDataFrame([(1, "<div><p>a<ul><li>b</li></ul></div>")], "page_id long, html string")
    plan = with_tree(shred_html(page))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    dealt = match(shred_html(page), "page_id", "ord", "tag", F.lit(0))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in dealt


def test_pages_of_unclosed_comments_and_scripts(spark):
    for opener, left in (("<!-- ", 1), ("<script ", 1), ("<script>", 3), ("<style>x", 3)):
        html = "<p>" + opener * (1_000_000 // len(opener))
        frame = spark.createDataFrame([(1, html)], "page_id long, html string")
        shred_html(frame).count()
        start = time.perf_counter()
        assert shred_html(frame).count() == left
        assert time.perf_counter() - start < 2


def _random_xml(rng, depth=0):
    inner = "".join(_random_xml(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 else ""
    tag = rng.choice("abcdx")
    return f"<{tag}>t{inner}</{tag}>" + rng.choice(("", "w"))


def _brute(nodes):
    by = {(r.doc_id, r.node_id): r for r in nodes}
    out = {}
    for (doc, node), r in by.items():
        chain, p = [], r.parent_id
        while p is not None:
            chain.insert(0, by[doc, p])
            p = by[doc, p].parent_id
        level, near = 1, {}
        for a in chain:
            level = 1 if a.tag == "b" else level + (a.tag == "a")
            if a.tag in "abc":
                near[a.tag] = a.node_id
        out[doc, node] = (chain[-1].tag if chain else None, near, level, [a.node_id for a in chain])
    return out


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_enclosing_and_owners_by_brute_force(spark, block):
    rng = random.Random(block)
    parts = [(f"d{i}", "content", f"<x>{_random_xml(rng)}{_random_xml(rng)}</x>") for i in range(8)]
    nodes = shred_xml(spark.createDataFrame(parts, "doc_id string, part string, content string"))
    expected = _brute(nodes.collect())
    marks = F.filter(F.array("tag"), lambda t: t.isin("a", "b", "c"))
    got = with_enclosing(nodes, marks, "a", ["b"], block=block).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r.parent_tag, dict(r.nearest), r.level) == expected[r.doc_id, r.node_id][:3]
    tags = {(r.doc_id, r.node_id): r.tag for r in got}
    pairs = {(r.doc_id, r.node_id, r.owner_id, r.owner_tag) for r in with_owners(nodes, F.col("tag").isin("a", "c"), block=block).collect()}
    wanted = {
        (d, n, o, tags[d, o]) for (d, n), e in expected.items() for o in (*e[3], n) if tags[d, o] in "ac"
    }
    assert pairs == wanted


def test_deep_nesting_costs_its_depth_once(spark):
    depth = 50_000
    xml = "<text:span xmlns:text='urn:oasis:names:tc:opendocument:xmlns:text:1.0'>" + "<text:span>" * depth + "x" + "</text:span>" * (depth + 1)
    nodes = shred_xml(spark.createDataFrame([("d", "content", xml)], "doc_id string, part string, content string"))
    assert "ancestors" not in nodes.columns
    start = time.perf_counter()
    row = placed(nodes).agg(F.count("*"), F.max("depth"), F.max(F.size("nearest")), F.max("parent_tag")).first()
    assert tuple(row) == (depth + 1, depth + 1, 0, "text:span")
    assert time.perf_counter() - start < 30
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 4 << 20
