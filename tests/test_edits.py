"""Edits that insert and drop rows, and publication in two phases."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafwright.operators import edits, update
from leafwright.sources import sinks

ROWS = (
    "row_id string, doc_id string, place array<long>, kind string, text string, href string, parent string, "
    "table_id long, y long, breaks boolean, protected boolean"
)


def _rows(spark, texts, doc="d", tables=None):
    made = []
    for i, text in enumerate(texts, 1):
        t, y = (tables or {}).get(i, (None, None))
        made.append((f"{doc}/{i}", doc, [i], "p", text, None, None, t, y, i == 4, i == 5))
    return spark.createDataFrame(made, ROWS)


def _docs(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def test_places_between_neighbours(spark):
    rng = random.Random(1)
    places = [[i] for i in range(1, 6)]
    for _ in range(40):  # always between two neighbours, wherever they come from
        at = rng.randrange(len(places) + 1)
        low = places[at - 1] if at else None
        high = places[at] if at < len(places) else [places[-1][0] + 1]
        frame = spark.createDataFrame([(low, high)], "low array<long>, high array<long>")
        new = frame.select(edits.between(F.col("low"), F.col("high")).alias("p")).first().p
        assert (low is None or low < new) and new < high
        places.insert(at, new)
    assert places == sorted(places)


def test_linkify_keeps_the_text_and_other_rows(spark):
    texts = ["no address", "see https://x.example/a, or mail a@b.de now", "https://y.example/ first", None, ""]
    rows = _rows(spark, texts).unionByName(_rows(spark, texts, "other"))
    after, allowed, outcomes = edits.linkify_rows(rows, _docs(spark, "d"))
    lines = after.filter("doc_id = 'd'").orderBy("place").collect()
    assert [tuple(r.place) for r in lines] == sorted(tuple(r.place) for r in lines)
    whole = {}
    for r in lines:
        whole[r.place[0]] = whole.get(r.place[0], "") + (r.text or "")
    assert [whole[i] for i in range(1, 6)] == [t or "" for t in texts]
    assert [r.href for r in lines if r.kind == "link"] == ["https://x.example/a", "mailto:a@b.de", "https://y.example/"]
    assert after.filter("doc_id = 'other'").exceptAll(rows.filter("doc_id = 'other'")).count() == 0
    columns = ["row_id", "kind", "text", "href", "parent", "breaks"]
    assert update.preserved(rows.select(columns), after.select(columns), "row_id", ["text"], allowed).count() == 0
    assert [(r.status, r["count"]) for r in outcomes.collect()] == [("applied", 2)]


def test_edits_search_every_text_once(spark):
    texts = ["a@b.de", "x@", "see ://x", "c d", " "]
    rows = _rows(spark, texts)
    joins = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    after, allowed, _ = edits.linkify_rows(rows, _docs(spark, "d"))
    assert sorted((tuple(r.place), r.text) for r in after.collect()) == [((1,), ""), ((1, 1 + 2), "a@b.de"), ((2,), "x@"), ((3,), "see ://x"), ((4,), "c d"), ((5,), " ")]
    assert joins(after) == 1 and joins(allowed) == 0  # with the chosen documents only
    assert joins(edits.drop_spacers(rows, _docs(spark, "d"))[0]) == 1


def test_spacers_with_breaks_or_protection_stay(spark):
    rows = _rows(spark, ["a", " ", None, "", "", "b", "  "])
    after, allowed, outcomes = edits.drop_spacers(rows, _docs(spark, "d", "none"))
    assert sorted(r.row_id for r in after.collect()) == ["d/1", "d/4", "d/5", "d/6"]
    assert {r.permission for r in allowed.collect()} == {"remove"} and allowed.count() == 3
    assert {r.doc_id: (r.status, r["count"]) for r in outcomes.collect()} == {"d": ("applied", 3), "none": ("unchanged", 0)}


@pytest.mark.parametrize("block", [2, 1 << 18])
def test_header_rows_stand_before_their_table(spark, block):
    tables = {2: (7, 1), 3: (7, 2), 4: (7, 3), 6: (8, 1), 7: (8, 2)}
    rows = _rows(spark, list("abcdefg"), tables=tables)
    asked = spark.createDataFrame([("d", 7, 2), ("d", 8, 2), ("d", 9, 1)], "doc_id string, table_id long, headers int")
    after, allowed, outcomes = edits.header_rows(rows, asked, block)
    lines = after.orderBy("place").collect()
    assert [r.kind for r in lines] == ["p", "header", *["p"] * 6]
    wrapper = lines[1].row_id
    assert [r.row_id for r in lines if r.parent == wrapper] == ["d/2", "d/3"]
    columns = ["row_id", "kind", "text", "href", "parent", "breaks"]
    assert update.preserved(rows.select(columns), after.select(columns), "row_id", ["parent"], allowed).count() == 0
    assert [(r.status, r["count"]) for r in outcomes.collect()] == [("failed", 2)]


def test_a_lost_or_second_publisher_replaces_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    see = lambda: sorted(r.v for r in sinks.published(spark, path).collect())
    assert sinks.published(spark, path) is None
    # two publishers stage on the same base: one commit wins
    one, two = sinks.stage(frame(1), path), sinks.stage(frame(2), path)
    assert sinks.published(spark, path) is None
    assert sinks.commit(spark, path, two) == "PUBLISHED"
    assert sinks.commit(spark, path, one) == "REFUSED" and sinks.commit(spark, path, one, replace=True) == "REFUSED"
    assert see() == [2]
    # a driver lost before its commit, and one lost while it wrote the commit
    sinks.stage(frame(3), path)
    assert see() == [2]
    (Path(path) / "commits" / "000000001").write_text('{"folder": "vers')
    assert see() == [2]
    assert sinks.publish(frame(4), path) == "REFUSED" and see() == [2]
    assert sinks.publish(frame(4, 5), path, replace=True) == "PUBLISHED" and see() == [4, 5]
    # a reader that began before goes on reading what it began with
    reader = sinks.published(spark, path)
    assert sinks.publish(frame(6), path, replace=True) == "PUBLISHED"
    assert sorted(r.v for r in reader.collect()) == [4, 5] and see() == [6]
