"""Readers, writers and streams over real files."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import leafwright
from leafwright.operators import findings
from leafwright.session import shared_dir, stored
from leafwright.sources import corpus as src
from leafwright.sources import records, sinks, validator, xml
from leafwright.sources.html import shred_html, with_tree
from leafwright.sources.xml import shred_xml
from leafwright.streaming import incremental
from tests.conftest import SF, rows

NS = "urn:oasis:names:tc:opendocument:xmlns:"
HEAD = (
    f'<office:document xmlns:office="{NS}office:1.0" xmlns:text="{NS}text:1.0" xmlns:draw="{NS}drawing:1.0" '
    f'xmlns:svg="{NS}svg-compatible:1.0" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:dc="http://purl.org/dc/elements/1.1/" '
    'office:version="1.3" office:mimetype="application/vnd.oasis.opendocument.text"><office:meta><dc:title>T</dc:title>'
    "<dc:language>en</dc:language></office:meta>"
    f'<office:styles xmlns:style="{NS}style:1.0" xmlns:fo="{NS}xsl-fo-compatible:1.0"><style:default-style style:family="paragraph">'
    '<style:text-properties fo:language="en"/></style:default-style></office:styles><office:body><office:text>'
)
FOOT = "</office:text></office:body></office:document>"
BAD = (
    '<text:h text:outline-level="2">1. Start</text:h><text:h text:outline-level="4">x</text:h><text:p>see https://a.b/c. now</text:p>'
    '<text:p/><text:a xlink:href="#none"/><text:list><text:p>x</text:p></text:list><draw:frame><draw:image/></draw:frame>'
)
HIDDEN = (
    '<text:section text:display="none"><text:h text:outline-level="5">x</text:h><text:p>https://a.b/c</text:p></text:section>'
    '<text:section text:condition="of:1"><text:list><text:p>x</text:p></text:list></text:section>'
)
TAIL = '<text:p>See <text:a xlink:href="https://x.example/">x</text:a> and http://tail.example/a</text:p>'
GOOD = '<text:h text:outline-level="1">Start</text:h><text:p>words<text:span> and </text:span>more</text:p>'


def _package(body: str, manifest: bool = True) -> bytes:
    buffer = io.BytesIO()
    flat = (HEAD + body + FOOT).replace("office:document ", "office:document-content ", 1).replace("</office:document>", "</office:document-content>")
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr(zipfile.ZipInfo("mimetype"), "application/vnd.oasis.opendocument.text")
        archive.writestr("content.xml", flat)
        archive.writestr("styles.xml", f'<office:document-styles xmlns:office="{NS}office:1.0" office:version="1.3"/>')
        archive.writestr("meta.xml", f'<office:document-meta xmlns:office="{NS}office:1.0" office:version="1.3"/>')
        if manifest:
            archive.writestr(
                "META-INF/manifest.xml",
                f'<manifest:manifest xmlns:manifest="{NS}manifest:1.0" manifest:version="1.3"><manifest:file-entry manifest:full-path="/" '
                'manifest:version="1.3" manifest:media-type="application/vnd.oasis.opendocument.text"/></manifest:manifest>',
            )
    return buffer.getvalue()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "bad.fodt").write_text(HEAD + BAD + FOOT)
    (folder / "good.fodt").write_text(HEAD + GOOD + FOOT)
    (folder / "hidden.fodt").write_text(HEAD + GOOD + HIDDEN + FOOT)
    (folder / "tail.fodt").write_text(HEAD + GOOD + TAIL + FOOT)
    (folder / "dtd.fodt").write_text("<!DOCTYPE x>" + HEAD + GOOD + FOOT)
    (folder / "bad.odt").write_bytes(_package(BAD))
    (folder / "good.odt").write_bytes(_package(GOOD))
    (folder / "nomanifest.odt").write_bytes(_package(GOOD, manifest=False))
    (folder / "broken.odt").write_bytes(b"PK\x03\x04 not a package")
    return str(folder)


def test_audit_of_files(spark, files):
    corpus = src.read_corpus(spark, files).withColumn("doc_id", F.col("path"))
    got: dict[str, set] = {}
    found = stored(leafwright.audit(corpus))
    for row in found.select("doc_id", "rule_id").collect():
        got.setdefault(row["doc_id"], set()).add(row["rule_id"])
    assert "good.fodt" not in got and "good.odt" not in got
    assert got["dtd.fodt"] == {"XML001"} and got["broken.odt"] == {"PKG001"}
    assert "PKG008" in got["nomanifest.odt"]
    assert not {"HEADING002", "HEADING003", "LINK001"} & got.get("hidden.fodt", set())
    assert "LINK001" in got["tail.fodt"]
    # Package and flat form of one document give the same findings.
    assert got["bad.odt"] == got["bad.fodt"]
    want = {"HEADING002", "HEADING003", "HEADING004", "LINK001", "LINK003", "LIST002", "REF001", "STYLE002", "GRAPHIC001"}
    assert want <= got["bad.fodt"]
    questions, carried = leafwright.plan(found.filter("doc_id = 'bad.fodt'"))
    assert carried is None and "heading.level" in {r["kind_id"] for r in questions.collect()}


def test_oversize_is_refused_not_dropped(spark, files):
    corpus = src.read_corpus(spark, files, limit=600)
    assert corpus.count() == 9 and corpus.filter("NOT admitted").count() >= 5


def test_xml_tree_and_tails(spark):
    parts = spark.createDataFrame([("d", "content", "<a>1<b x='2'>3</b>4<c/>5</a>")], "doc_id string, part string, content string")
    got = rows(shred_xml(parts), "node_id", "parent_id", "ord", "tag", "text", "tail", "last_id")
    assert got == [(1, None, 1, "a", "1", None, 3), (2, 1, 1, "b", "3", "4", 2), (3, 1, 2, "c", None, "5", 3)]


def test_html_tree(spark):
    page = "<html><body><!-- <p> --><ul><li>a<br>b</li><li><b>c</li></ul><script>var t='</p>';</script></body></html>"
    frame = spark.createDataFrame([(1, page)], "page_id long, html string")
    tree = with_tree(shred_html(frame), block=2)
    assert [tuple(r) for r in tree.orderBy("ord").select("tag", "depth", "parent_tag").collect()] == [
        ("html", 1, None), ("body", 2, "html"), ("ul", 3, "body"), ("li", 4, "ul"), ("br", 5, "li"), ("li", 4, "ul"), ("b", 5, "li"), ("script", 3, "body"),
    ]


def test_validator_files_keep_clauses_as_text(spark, tmp_path):
    rule = '<rule specification="ISO" clause="7.10" testNumber="1" status="failed" failedChecks="2"><description>d</description><check status="failed"><context>c</context><errorMessage>m</errorMessage></check></rule>'
    body = f'<report><validationReport isCompliant="false" jobEndStatus="normal" profileName="p"><details failedRules="1">{rule}</details></validationReport></report>'
    (tmp_path / "r.xml").write_text(body)
    reports = validator.read_validation(spark, str(tmp_path))
    row = validator.failed_rules(reports).first()
    assert (row["clause"], row["failed_checks"], row["contexts"]) == ("7.10", 2, ["c"])
    assert validator.validate_reports(reports).first()["status"] == 2


def test_strict_records(spark, tmp_path):
    lines = [{"id": "a", "source": "x", "plan": "p"}, {"id": "A", "source": "x", "plan": "p"}, {"id": "b", "source": "/x", "plan": "p"}, {"id": "c", "source": "x", "plan": "p", "y": "1"}]
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, lines)))
    assert [r["problem"] for r in records.read_batch(spark, str(tmp_path)).orderBy("id").collect()] == ["duplicate id", "duplicate id", "path", "keys"]
    (tmp_path / "a.jsonl").write_text('{"plan_id":"1","kind_id":"heading.level","path":"p","answer":{"level":2}}\n{"plan_id":\n'
        '{"plan_id":"1","kind_id":"k","more":1}\n{"plan_id":"1","kind_id":"k","answer":{"levle":2}}\n')
    good, bad = records.read_answers(spark, str(tmp_path / "a.jsonl"))
    assert [r.level for r in good.select("answer.level").collect()] == [2] and bad.count() == 3


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("d", "HEADING001", "content/p[1]"), ("d", "LINK001", "/etc/x")], "doc_id string, rule_id string, path string")
    rows_ = findings.union_findings(findings.raise_rule(found, F.col("rule_id"), path=F.col("path")))
    target = str(tmp_path / "f")
    sinks.write_findings(rows_, target)
    assert spark.read.parquet(target).count() == 2
    assert sinks.publish(found, target) == "REFUSED"
    assert sinks.publish(found, str(tmp_path / "n"), dry_run=True) == "PREVIEW" and not (tmp_path / "n").exists()
    assert sinks.publish(found, str(tmp_path / "n"), found) == "REFUSED"
    assert sinks.publish(found, str(tmp_path / "n")) == "PUBLISHED"
    assert sinks.publish(found, str(tmp_path / "n"), replace=True) == "PUBLISHED"
    results = sinks.sarif(rows_.withColumn("run", F.lit("r")).withColumn("n", F.lit(1)), "run", "n", "doc_id")
    assert rows(results, "rule_index", "level", "safe") == [(0, "error", True), (1, "warning", False)]
    part = sinks.sarif_parts(results, "run", ["artifact_index", "pos", "rule_id"], 1).orderBy("part").collect()
    assert [json.loads(p["results"])[0]["ruleId"] for p in part] == ["HEADING001", "LINK001"]


def test_streams_equal_batches(spark):
    stream = incremental.stream_table(spark, SF, "documents").withColumn("sha256", F.sha2("text", 256))
    stream = stream.withColumn("doc_id", F.col("doc_id").cast("string"))
    folder = incremental.audit_stream(stream, incremental.run_folder(spark, "t"), lambda b: b.filter("lang = 'en'").select("doc_id"))
    batch = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    assert spark.read.parquet(folder).count() == batch.count()


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    frame = spark.range(5).withColumn("t", F.lit("x"))
    again = stored(frame)
    assert again.schema.names == frame.schema.names and again.count() == 5


def test_large_xml_is_flushed_while_read(spark):
    body = "".join(f"<p n='{i}'>{i}</p>t" for i in range(60_000))
    parts = spark.createDataFrame([("big", "content", f"<a>{body}</a>"), ("cut", "content", f"<a>{body}")], "doc_id string, part string, content string")
    nodes = shred_xml(parts)
    big = nodes.filter("doc_id = 'big' AND tag = 'p'")
    assert big.count() == 60_000 and big.filter("tail <> 't' OR text <> attrs['n']").count() == 0
    assert rows(nodes.filter("problem IS NOT NULL"), "doc_id", "problem") == [("cut", "ParseError")]


def test_a_file_no_row_can_hold_is_refused_unread(spark, tmp_path):
    (tmp_path / "small.txt").write_bytes(b"x")
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(3 << 30)  # sparse
    rows = {r.path: r for r in src.read_corpus(spark, str(tmp_path)).drop("content").collect()}
    assert rows["small.txt"].admitted and rows["small.txt"].sha256
    assert not rows["large.bin"].admitted and rows["large.bin"].n_bytes == 3 << 30


def test_batches_of_nodes_are_bounded_by_their_text():
    line = f"<p>{'x' * 100_000}</p>"
    documents = [f"<a>{line * 10}</a>".encode() for _ in range(20)] + [b"<a><", None]
    given = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(22)], "part": ["c"] * 22, "content": documents})
    found = list(xml._read(iter([given.slice(0, 0), given])))
    assert max(b.nbytes for b in found) < 2 * xml._FLUSH_CHARS and len(found) > 4
    assert sum(b.num_rows for b in found) == 20 * 11 + 2
    assert sum(len(t or "") for b in found for t in b.column("text").to_pylist()) == 20 * 1_000_000
