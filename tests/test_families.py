"""Audits of spreadsheets, presentations, charts, formulas, images and databases from real XML."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import leafwright
from leafwright.sources.corpus import identify

NS = "urn:oasis:names:tc:opendocument:xmlns:"
PREFIXES = {"office": "office", "text": "text", "table": "table", "draw": "drawing", "svg": "svg-compatible", "chart": "chart", "db": "database"}


def flat(kind: str, body: str, element: str) -> str:
    names = " ".join(f'xmlns:{p}="{NS}{n}:1.0"' for p, n in PREFIXES.items())
    return (
        f'<office:document {names} xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:dc="http://purl.org/dc/elements/1.1/" office:version="1.3" '
        f'office:mimetype="application/vnd.oasis.opendocument.{kind}"><office:meta><dc:title>T</dc:title><dc:language>en</dc:language>'
        f"</office:meta><office:body><office:{element}>{body}</office:{element}></office:body></office:document>"
    )


def cell(words: str = "", extra: str = "") -> str:
    return f"<table:table-cell {extra}><text:p>{words}</text:p></table:table-cell>"


def table(name: str, *rows: str) -> str:
    return f'<table:table table:name="{name}">{"".join(f"<table:table-row>{r}</table:table-row>" for r in rows)}</table:table>'


SHEETS = table("Sheet1", cell("a") + cell("b"), cell("1") + cell("2")) + table("Mine", cell()) + table("Late", cell())
HEADED = (
    '<table:table table:name="t"><table:table-header-rows><table:table-row>' + cell("h") + cell("i")
    + "</table:table-row></table:table-header-rows><table:table-row>" + cell("1") + cell("2") + "</table:table-row></table:table>"
)
WIDE = table("w", cell("a", 'table:number-columns-spanned="3"'), cell("1", 'office:value-type="float"') + cell("2"))
PAGES = (
    '<draw:page draw:name="p"><svg:title>t</svg:title><draw:rect xml:id="a"/><draw:rect xml:id="b"/></draw:page>'
    '<draw:page draw:name="p" draw:nav-order="c"><draw:rect xml:id="c"/></draw:page>'
)
CHART = (
    '<chart:chart xlink:href="http://x"><chart:title><text:p>c</text:p></chart:title><chart:plot-area>'
    '<chart:series chart:values-cell-range-address="nonsense"/></chart:plot-area></chart:chart>'
)
DATABASE = (
    '<db:data-source><db:connection-resource xlink:href="sdbc:mysql://bob@h/d"/><db:login db:user-name="bob"/></db:data-source>'
    '<db:queries><db:query db:name="q"/></db:queries>'
)
TRACKED = (
    "<text:tracked-changes><text:changed-region text:id='a'><text:deletion/></text:changed-region>"
    "<text:changed-region text:id='b'><text:insertion/></text:changed-region></text:tracked-changes>"
    "<text:h text:outline-level='1'>x</text:h><text:p><text:change text:change-id='a'/><text:change text:change-id='z'/></text:p>"
)
LOCAL = table("local-table", *[cell(f"c{i}") + cell(str(i), 'office:value-type="float"') + cell("x" if i == 3 else "1", 'office:value-type="float"' if i != 3 else "") for i in range(1, 5)])


def chart(values: str, categories: str = "local-table.A1:local-table.A4") -> str:
    plot = f'<chart:axis><chart:categories table:cell-range-address="{categories}"/></chart:axis><chart:series chart:values-cell-range-address="{values}"/>'
    return flat("chart", f"<chart:chart><chart:title><text:p>c</text:p></chart:title><chart:plot-area>{plot}</chart:plot-area>{LOCAL}</chart:chart>", "chart")


SERIES = {"CHART009", "CHART010", "CHART011"}
CASES = {
    "c1.fodc": (chart("local-table.B1:local-table.B4"), set(), SERIES),
    "c2.fodc": (chart("local-table.B1:local-table.B3"), {"CHART010"}, {"CHART009", "CHART011"}),
    "c3.fodc": (chart("local-table.C1:local-table.C4"), {"CHART011"}, {"CHART009", "CHART010"}),
    "c4.fodc": (chart("local-table.B1:local-table.C2"), {"CHART009"}, {"CHART010", "CHART011"}),
    "c5.fodc": (chart("other.B1:other.B3"), set(), SERIES),
    "r.fodt": (flat("text", TRACKED, "text"), {"REVISION003", "REVISION004", "REVISION006"}, {"REVISION001", "REVISION002", "REVISION005"}),
    "s.fods": (flat("spreadsheet", SHEETS, "spreadsheet"), {"SHEET002", "SHEET003", "TABLE004"}, {"SHEET001", "TABLE005"}),
    "t.fodt": (flat("text", "<text:h text:outline-level='1'>x</text:h>" + HEADED, "text"), set(), {"TABLE001", "TABLE002", "TABLE003"}),
    "w.fodt": (flat("text", "<text:h text:outline-level='1'>x</text:h>" + WIDE, "text"), {"TABLE002"}, {"TABLE001"}),
    "p.fodp": (flat("presentation", PAGES, "presentation"), {"PAGE002", "PAGE003", "PAGE005"}, {"PAGE001", "PAGE004"}),
    "c.fodc": (flat("chart", CHART, "chart"), {"CHART004", "CHART006", "CHART007"}, {"CHART001", "CHART002", "CHART003"}),
    "i.fodi": (flat("image", "<draw:frame><draw:image xlink:href='Pictures/x.png'/></draw:frame>", "image"), {"IMAGE005", "ODF009"}, {"IMAGE003", "IMAGE004"}),
    "d.fodb": (flat("base", DATABASE, "database"), {"DATABASE004", "DATABASE005", "DATABASE006", "DATABASE009", "DATABASE011"}, {"DATABASE001", "DATABASE002"}),
    "f.fodf": ("<math xmlns='http://www.w3.org/1998/Math/MathML'><mi> </mi></math>", {"ODF006"}, {"XML001"}),
}


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(n, c[0]) for n, c in CASES.items()], "n string, t string")
    result: dict[str, set] = {}
    for row in leafwright.audit(identify(frame, F.col("n"), F.col("n"), F.col("t"))).select("doc_id", "rule_id").collect():
        result.setdefault(row["doc_id"], set()).add(row["rule_id"])
    return result


@pytest.mark.parametrize("name", sorted(CASES))
def test_family(found, name):
    _, wanted, unwanted = CASES[name]
    got = found.get(name, set())
    assert wanted <= got
    assert not unwanted & got


def test_formula_checks(spark):
    from leafwright.plans.families import math_findings
    from leafwright.plans.nodes import placed
    from leafwright.sources.xml import shred_xml

    xml = "<math xmlns='http://www.w3.org/1998/Math/MathML' {}>{}</math>"
    rows = [("bad", "content", xml.format("", "<mphantom><mi>x</mi></mphantom><mi> </mi>")), ("good", "content", xml.format("alttext='x'", "<mi>x</mi>"))]
    nodes = placed(shred_xml(spark.createDataFrame(rows, "doc_id string, part string, content string")))
    got = {(r["doc_id"], r["rule_id"]) for r in math_findings(nodes).collect()}
    assert got == {("bad", "MATH002"), ("bad", "MATH003")}
