"""The use cases end to end on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import leafwright
from tests.conftest import rows


def test_remediate_refuses_whole_documents(spark):
    table = spark.createDataFrame([(1, "d", "a"), (2, "d", "b"), (3, "e", "c")], "k long, doc string, name string")
    bound = spark.createDataFrame([(1, "x"), (3, "y")], "k long, name string")
    out = leafwright.remediate(table, bound, "k", ["name"], "doc")
    assert rows(out["state"], "doc_id", "state") == [("d", "preview"), ("e", "preview")]
    assert rows(out["candidate"].select("k", "name")) == [(1, "x"), (2, "b"), (3, "y")]


def test_compare(spark):
    schema = "doc_id string, page long, width double, height double, text string"
    before = spark.createDataFrame([("d", 1, 10.0, 10.0, "one two"), ("e", 1, 10.0, 10.0, "same")], schema)
    after = spark.createDataFrame([("d", 1, 11.0, 10.0, "one too"), ("e", 1, 10.0, 10.0, "same")], schema)
    links = spark.createDataFrame([("d", "u")], "doc_id string, uri string")
    got = leafwright.compare(before, after, links, links.filter("false"))
    assert rows(got, "doc_id", "rule_id") == [("d", "FIDELITY002"), ("d", "FIDELITY003"), ("d", "FIDELITY004")]


def test_run_and_batch(spark):
    names = [f"result_{i}" for i in range(1, 9)]
    schema = "item long, level int, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(1, 2, *["passed"] * 8), (2, 2, "passed", "crashed", *["passed"] * 6)], schema)
    stages, runs = leafwright.run(docs)
    assert stages.count() == 16
    assert rows(runs, "item", "failed_stage", "exit_status") == [(1, None, 0), (2, "export-source", 3)]
    items = spark.createDataFrame([(1, "b", True, False), (2, "b", True, False), (3, "b", False, False)], "item long, batch string, started boolean, interrupted boolean")
    states, whole = leafwright.batch(items, runs, ["batch"])
    assert rows(states, "item", "item_status") == [(1, "completed"), (2, "failed"), (3, "pending")]
    assert rows(whole, "batch_status", "exit_status", "n_pending") == [("running", 3, 1)]


def test_verify_evidence(spark):
    recorded = spark.createDataFrame([("b", "x", "1")], "bundle_id string, name string, sha256 string")
    observed = recorded.withColumn("kind", F.lit("file"))
    assert leafwright.verify_evidence(recorded, observed).count() == 0


def test_audit_pdf(spark):
    meta = "doc_id string, title string, language string, marked boolean, has_structure boolean, display_title boolean, ua_part string, pages int, text_chars int"
    docs = spark.createDataFrame([("bad", None, "en", True, True, True, "1", 1, 0), ("good", "t", "en", True, True, True, "1", 1, 9)], meta)
    node = "doc_id string, node_id long, parent_id long, raw_role string, alt string, page_ref long, ancestors array<long>"
    nodes = spark.createDataFrame(
        [
            ("bad", 1, None, "Document", None, 1, [1]), ("bad", 2, 1, "H2", None, 1, [1, 2]), ("bad", 3, 1, "H4", None, 1, [1, 3]),
            ("bad", 4, 1, "Figure", None, 1, [1, 4]), ("bad", 5, 1, "Odd", None, 1, [1, 5]), ("bad", 6, 1, "L", None, 1, [1, 6]), ("bad", 7, 6, "P", None, 1, [1, 6, 7]),
            ("good", 1, None, "Document", None, 1, [1]), ("good", 2, 1, "Title", None, 1, [1, 2]), ("good", 3, 1, "Link", "a", 1, [1, 3]),
        ],
        node,
    )
    refs = spark.createDataFrame([("good", 3, 70, None, 1, None), ("good", 2, None, 9, 1, 0), ("bad", 2, None, 9, 1, 5)], "doc_id string, node_id long, object_ref long, stream_ref long, page_ref long, mcid int")
    annots = spark.createDataFrame([("good", 70, 1, "to"), ("bad", 71, 1, None)], "doc_id string, annot_ref long, page_ref long, contents string")
    streams = spark.createDataFrame([("good", 9, [0], [], 0), ("bad", 9, [1], [], 3)], "doc_id string, stream_ref long, mcids array<int>, graphical_mcids array<int>, unmarked_text_ops long")
    roles = spark.createDataFrame([("good", "Title", "H1"), ("bad", "Odd", "Odd")], "doc_id string, role string, mapped string")
    got: dict[str, set] = {}
    for row in leafwright.audit_pdf(docs, nodes, refs, annots, streams, roles).select("doc_id", "rule_id").collect():
        got.setdefault(row["doc_id"], set()).add(row["rule_id"])
    assert "good" not in got
    assert got["bad"] == {"PDF002", "PDF008", "PDF011", "PDF012", "PDF013", "PDF014", "PDF017", "PDF020", "PDF021", "PDF022", "PDF024", "PDF025"}
