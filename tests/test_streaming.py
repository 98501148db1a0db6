"""Streams: identity across batches and restarts, and state that leaves."""

from __future__ import annotations

import collections
import datetime as dt

from pyspark.sql import functions as F

from leafwright.bindings import QUERIES
from leafwright.sources.corpus import identify
from leafwright.streaming import incremental
from tests.conftest import rows
from tests.test_families import flat


def _arrive(spark, folder, name, docs):
    frame = spark.createDataFrame(docs, "doc_id string, content string")
    identify(frame, F.col("doc_id"), F.col("doc_id"), F.col("content").cast("binary")).coalesce(1).write.parquet(f"{folder}/{name}")


def _stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/1").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def test_a_document_fed_twice_is_audited_once(spark, tmp_path):
    one = flat("text", "<text:h text:outline-level='2'>x</text:h>", "text")
    two = flat("text", "<text:p>y</text:p>", "text")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _arrive(spark, folder, "1", [("a.fodt", one), ("a.fodt", one), ("b.fodt", two)])
    # the library's own audit
    findings = incremental.audit_stream(_stream(spark, folder), out)
    first = collections.Counter(map(tuple, spark.read.parquet(findings).select("doc_id", "rule_id").collect()))
    assert first["a.fodt", "HEADING002"] + first["a.fodt", "HEADING001"] >= 1 and first["b.fodt", "HEADING005"] == 1
    # a restart: a known document, the same bytes under another name, a changed one
    _arrive(spark, folder, "2", [("a.fodt", one), ("c.fodt", one), ("b.fodt", one)])
    incremental.audit_stream(_stream(spark, folder), out)
    rows = spark.read.parquet(findings)
    second = collections.Counter(map(tuple, rows.filter("batch > 0").select("doc_id", "rule_id").collect()))
    assert {d for d, _ in second} == {"b.fodt", "c.fodt"}
    assert {r: n for (d, r), n in second.items() if d == "c.fodt"} == {r: n for (d, r), n in first.items() if d == "a.fodt"}
    ledger = spark.read.parquet(f"{out}/ledger")
    assert ledger.count() == ledger.select("doc_id", "sha256", "version").distinct().count() == 4


def test_new_rules_and_documents_without_digest(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    toy = lambda batch: batch.select("doc_id", "sha256")
    _arrive(spark, folder, "1", [("a", "x"), ("n", None)])
    findings = incremental.audit_stream(_stream(spark, folder), out, toy)
    _arrive(spark, folder, "2", [("a", "x"), ("n", None)])
    incremental.audit_stream(_stream(spark, folder), out, toy)
    assert sorted(r.doc_id for r in spark.read.parquet(findings).collect()) == ["a", "n"]
    _arrive(spark, folder, "3", [("a", "x")])
    incremental.audit_stream(_stream(spark, folder), out, toy, version="2")
    assert sorted(r.doc_id for r in spark.read.parquet(findings).collect()) == ["a", "a", "n"]


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def failing(batch):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return batch.select("doc_id", "sha256")

    _arrive(spark, folder, "1", [("a", "x")])
    findings = incremental.audit_stream(_stream(spark, folder), out, failing)
    _arrive(spark, folder, "2", [("a", "x"), ("b", "y")])
    try:
        incremental.audit_stream(_stream(spark, folder), out, failing)
        raise AssertionError("the batch should have failed")
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    incremental.audit_stream(_stream(spark, folder), out, failing)
    assert sorted(r.doc_id for r in spark.read.parquet(findings).collect()) == ["a", "b"]


def test_a_given_table_may_be_a_folder_of_files(spark, tmp_path):
    documents = [(i, f"word {i}", "es" if i % 3 else "en") for i in range(40)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["j1_audit_stream"](spark, str(tmp_path))
    assert rows(found) == sorted((str(i), "LANG001") for i, _, lang in documents if lang == "es")
    at = dt.datetime(2024, 1, 1)
    events = [(i, i % 4, "view", at + dt.timedelta(hours=i)) for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    assert sum(n for *_, n in rows(QUERIES["j2_progress_fold"](spark, str(tmp_path)))) == 40


def test_state_leaves_after_the_delay(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "item string, step string, state string, ts timestamp"
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    batches = [
        [(f"i{k}", "s", "running", at(1, k % 20)) for k in range(50)],
        [("i0", "s", "passed", at(1, 23)), ("i1", "s", "failed", at(1, 23))],
        [("i0", "s", "failed", at(9)), ("i0", "s", "running", at(9))],
        [("z", "s", "running", at(20))],
        [("i1", "s", "passed", at(2))],  # too late by then
    ]
    states = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        query = incremental.progress_query(stream, out)
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    assert states[0] == 50 and max(states[2:]) <= 2
    latest = {r.item: (r.state, r.n_events) for r in incremental.latest_progress(spark, f"{out}/updates").collect()}
    assert latest["i0"] == ("failed", 4) and latest["i1"] == ("failed", 2) and latest["i2"] == ("running", 1) and len(latest) == 51
