"""Languages, styles, hidden content, ranges and resources: a triggering and a repaired document per rule."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

import leafwright
from leafwright.sources.corpus import identify
from tests.test_families import NS, PREFIXES

SPACES = " ".join(f'xmlns:{p}="{NS}{n}:1.0"' for p, n in {**PREFIXES, "style": "style", "fo": "xsl-fo-compatible", "presentation": "presentation"}.items())


def doc(kind, element, body, styles="", automatic=""):
    return (
        f'<office:document {SPACES} xmlns:xlink="http://www.w3.org/1999/xlink" office:version="1.3" office:mimetype="application/vnd.oasis.opendocument.{kind}">'
        f"<office:styles>{styles}</office:styles><office:automatic-styles>{automatic}</office:automatic-styles>"
        f"<office:body><office:{element}>{body}</office:{element}></office:body></office:document>"
    )


def style(name, parent=None, inner="", family="paragraph"):
    up = f' style:parent-style-name="{parent}"' if parent else ""
    return f'<style:style style:name="{name}" style:family="{family}"{up}>{inner}</style:style>'


EN = '<style:text-properties fo:language="en"/>'
DEFAULT = f'<style:default-style style:family="paragraph">{EN}</style:default-style>'
P = '<text:p text:style-name="{}">words</text:p>'
BREAK = '<style:paragraph-properties fo:break-before="page"/>'
SHEET = '<table:table table:name="a" table:style-name="{}"><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell></table:table-row></table:table>'
HIDDEN = '<style:table-properties table:display="false"/>'


def package(href):
    content = doc("text", "text", f'<text:p>x</text:p><draw:frame><draw:image xlink:href="{href}"/></draw:frame>', DEFAULT).replace(
        "office:document ", "office:document-content ", 1).replace("</office:document>", "</office:document-content>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        archive.writestr("content.xml", content)
        archive.writestr("styles.xml", content.replace("document-content", "document-styles"))
        archive.writestr("Pictures/a.png", b"x")
        archive.writestr("META-INF/manifest.xml", '<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.text"/></manifest:manifest>')
    return buffer.getvalue()


MARKS = '<text:p>a<text:bookmark-start text:name="b"/>x<text:bookmark-{} text:name="b"/></text:p>'
CASES = {  # name: (document, rules that must be there, rules that must not)
    "silent.fodt": (doc("text", "text", P.format("A"), style("A", "B") + style("B")), {"LANG001"}, {"LANG002", "STYLE001"}),
    "inherited.fodt": (doc("text", "text", P.format("A"), style("A", "B") + style("B", None, EN)), set(), {"LANG001", "LANG002", "STYLE001"}),
    "default.fodt": (doc("text", "text", P.format("A") + "<text:p>bare</text:p>", DEFAULT + style("A")), set(), {"LANG001", "LANG002"}),
    "bare.fodt": (doc("text", "text", "<text:p>bare</text:p>"), {"LANG001"}, {"LANG002"}),
    "cyclic.fodt": (doc("text", "text", P.format("A"), style("A", "B") + style("B", "A", EN)), {"LANG002", "STYLE001"}, {"LANG001"}),
    "unknown.fodt": (doc("text", "text", P.format("Z"), DEFAULT), {"LANG002", "STYLE001"}, {"LANG001"}),
    "conditional.fodt": (doc("text", "text", P.format("A"), DEFAULT + style("A", None, EN + '<style:map style:condition="x" style:apply-style-name="B"/>')), {"LANG002", "STYLE001"}, set()),
    "unused.fodt": (doc("text", "text", "<text:p>x</text:p>", DEFAULT + style("A", "gone")), set(), {"LANG002", "STYLE001"}),
    "sheet.fods": (doc("spreadsheet", "spreadsheet", SHEET.format("H"), "", style("H", None, HIDDEN, "table")), {"ORDER003"}, set()),
    "parent.fods": (doc("spreadsheet", "spreadsheet", SHEET.format("K"), style("H", None, HIDDEN, "table"), style("K", "H", "", "table")), {"ORDER003"}, set()),
    "shown.fods": (doc("spreadsheet", "spreadsheet", SHEET.format("H"), "", style("H", None, "", "table") + style("H", None, HIDDEN, "drawing-page")), set(), {"ORDER003"}),
    "page.fodp": (doc("presentation", "presentation", '<draw:page draw:name="p" draw:style-name="d"/>', "", style("d", None, '<style:drawing-page-properties presentation:visibility="hidden"/>', "drawing-page")), {"ORDER003"}, set()),
    "ends.fodt": (doc("text", "text", MARKS.format("end"), DEFAULT), set(), {"REF003"}),
    "starts.fodt": (doc("text", "text", MARKS.format("start"), DEFAULT), {"REF003"}, set()),
    "hidden.fodt": (doc("text", "text", '<text:p><text:span>see https://x.example/ <text:hidden-paragraph text:condition="c"/></text:span><text:a xlink:href="#a"/></text:p>', DEFAULT), set(), {"LINK001", "LINK003"}),
    "beside.fodt": (doc("text", "text", '<text:p><text:hidden-paragraph text:condition="c"/></text:p><text:p>see https://x.example/</text:p><text:p><text:a xlink:href="#a"/></text:p>', DEFAULT), {"LINK001", "LINK003"}, set()),
    "around.fodt": (doc("text", "text", '<text:p>see https://x.example/ <draw:frame><draw:text-box><text:p><text:hidden-paragraph/>https://y.example/</text:p></draw:text-box></draw:frame></text:p>', DEFAULT), {"LINK001"}, set()),
    "field.fodt": (doc("text", "text", "<text:p><text:file-name>f</text:file-name></text:p>", DEFAULT), {"NATIVE002"}, {"NATIVE001"}),
    "missing.odt": (package("Pictures/b.png"), {"NATIVE001"}, {"NATIVE002"}),
    "there.odt": (package("Pictures/a.png"), set(), {"NATIVE001"}),
}


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(n, c[0].encode() if isinstance(c[0], str) else c[0]) for n, c in CASES.items()]
    rows += [("break.fodt", doc("text", "text", '<text:p text:style-name="A"/><text:p/>', DEFAULT + style("A", "B") + style("B", None, BREAK)).encode())]
    frame = spark.createDataFrame(rows, "n string, t binary")
    return leafwright.audit(identify(frame, F.col("n"), F.col("n"), F.col("t")))


def test_rules(findings):
    got: dict[str, set] = {}
    for row in findings.select("doc_id", "rule_id").collect():
        got.setdefault(row.doc_id, set()).add(row.rule_id)
    wrong = {n: (w - got.get(n, set()), u & got.get(n, set())) for n, (_, w, u) in CASES.items() if w - got.get(n, set()) or u & got.get(n, set())}
    assert not wrong


def test_breaks_of_empty_paragraphs_come_with_their_style(spark, findings):
    from leafwright.plans import nodes as odf
    from leafwright.plans.styles import effective

    row = findings.filter("doc_id = 'break.fodt' AND rule_id = 'STYLE002'").first()
    assert row.details["count"] == "2"
    frame = spark.createDataFrame([("d", doc("text", "text", "", DEFAULT + style("A", "B") + style("B", None, BREAK)))], "n string, t string")
    nodes = odf.document_nodes(identify(frame, F.col("n"), F.col("n"), F.col("t").cast("binary")))
    found = {(r.family, r.style): (r.parent, r.status, r.props) for r in effective(nodes).collect()}
    assert found["paragraph", "A"] == ("B", None, {"breaks": "true", "western": "en"}) and found["paragraph", ""][2] == {"western": "en"}


def test_questions_of_silent_paragraphs(findings):
    questions, _ = leafwright.plan(findings)
    asked = {(r.doc_id, r.kind_id, r.path) for r in questions.filter("kind_id = 'language.target'").collect()}
    assert ("silent.fodt", "language.target", "content/paragraph[1]") in asked
