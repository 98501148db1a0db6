"""The stages, each against a plain version of what it should keep."""

from __future__ import annotations

import collections

import corpus_pipeline
import pytest
from leafwright.llm import line_spread, quality
from tests.conftest import SF
from tests.llm.test_operators import _least, _sets, words


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def test_stages_return_documents(steps):
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[:-1])
    assert all(s.count() > 0 for s in steps)


def test_quality_stage(steps):
    kept = {r.doc_id for r in quality.judge(steps[0]).filter("kept").collect()}
    assert {r.doc_id for r in steps[1].collect()} == kept


def test_line_stage(steps):
    before = {r.doc_id: r for r in steps[1].collect()}
    sites = collections.defaultdict(set)
    for r in before.values():
        for line in r.text.split("\n"):
            sites[line].add(r.source)
    gone = {x for x, s in sites.items() if len(s) >= line_spread.MIN_SITES and words(x)}
    for r in steps[2].collect():
        lost = [x for x in before[r.doc_id].text.split("\n") if x not in r.text.split("\n")]
        assert set(lost) <= gone and r.n_chars == len(r.text)


def test_near_duplicate_stage(steps):
    sets = _sets([(r.doc_id, r.text) for r in steps[2].collect()])
    ids = sorted(sets)
    linked = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert {r.doc_id for r in steps[3].collect()} == set(_least(ids, linked).values())


def test_mixing_stage(steps):
    before, after = ({}, collections.Counter())
    for r in steps[3].collect():
        before[r.doc_id] = r
    for r in steps[4].collect():
        after[r.doc_id] += 1
        assert before[r.doc_id].text == r.text
    assert max(after.values()) <= 2
    total = sum(len(words(r.text)) for r in before.values())
    taken = sum(len(words(before[i].text)) * n for i, n in after.items())
    assert taken == pytest.approx(1.5 * total, rel=0.1)


def test_token_stage(steps):
    import hashlib

    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


LONG = " ".join(f"the word{i} of" for i in range(60))
OTHER = " ".join(f"the thing{i} of" for i in range(60))
ROWS = [
    (1, LONG, "en", "a", 1), (1, OTHER, "en", "a", 1), (2, OTHER.replace("thing", "item"), "en", "b", 1), (3, LONG, "en", "b", 2),
    (3, LONG, "en", "b", 2), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n ", "en", "a", 3), (None, LONG, "en", "a", 1),
    (7, LONG + "\n" + " ".join(f"der satz{i} und" for i in range(20_000)), "de", None, 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("__key", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("id", F.lit(0)).withColumn("copies", F.lit("x"))


@pytest.mark.parametrize("place", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, place):
    name, stage = corpus_pipeline.STAGES[place]
    rows = stage(spark, odd, SF).collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    ids = collections.Counter(r.doc_id for r in rows)
    if place == 0:  # blank texts go; all others have enough stop words
        assert ids == collections.Counter({1: 2, 2: 1, 3: 2, None: 1, 7: 1})
    elif place == 1:  # no line is on enough sites
        assert ids == collections.Counter(r[0] for r in ROWS)
    elif place == 2:
        texts = {(r.doc_id, r.text) for r in rows}
        # id 1 has two texts: both stay, each for its own group; 3 is a copy of the first
        assert texts == {(r[0], r[1]) for r in ROWS if r[0] != 3} and len(rows) == len(texts)
    elif place == 3:
        assert all(n <= 2 * sum(r[0] == i for r in ROWS) for i, n in ids.items())
    else:
        assert ids == collections.Counter(r[0] for r in ROWS)


def test_shared_ids_lose_no_document_and_reruns_agree(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "b", 1), (1, OTHER, "en", "a", 1), (2, "C c c", "en", "a", 1)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    first = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()))
    again = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs.repartition(5), SF).collect()))
    assert first == again and [(r[0], r[1]) for r in first] == [(1, OTHER), (1, LONG), (2, "C c c")]
