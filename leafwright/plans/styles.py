"""Styles of audited documents: what each one says once its parents are followed, and what depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import is_blank
from leafwright.functions.uri import local_resource
from leafwright.operators import documents, graph, references
from leafwright.operators import findings as fo
from leafwright.operators.sequence import first_list
from leafwright.plans import nodes as odf
from leafwright.session import stored

# Elements that load a file, and whether a folder of the package will do.
RESOURCES = {"draw:image": False, "draw:object": True, "draw:object-ole": False, "draw:fill-image": False}
NO_LANGUAGE = ["", "none", "zxx"]


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def styles_of(nodes: DataFrame) -> DataFrame:
    """doc_id, family, name, parent, conditional, props of every style; the default of a family has no name.

    ``props``: western, asian, complex (languages), hidden and breaks, where the style says so itself.
    Automatic styles of page headers stand apart from the document's and are left out.
    """
    rows = nodes.filter("problem IS NULL").filter(~((F.col("part") == "styles") & odf.above("office:automatic-styles")))
    kept = ["doc_id", "part", "node_id"]
    named = rows.filter(F.col("tag").isin("style:style", "style:default-style")).select(
        *kept, _attr("style:family").alias("family"), F.when(F.col("tag") == "style:style", F.coalesce(_attr("style:name"), F.lit(""))).alias("name"),
        _attr("style:parent-style-name").alias("parent"), (F.coalesce(_attr("style:master-page-name"), F.lit("")) != "").alias("__page"),
    )
    language = lambda a: F.when(~F.lower(_attr(a)).isin(NO_LANGUAGE), _attr(a))
    breaks = lambda a: F.coalesce(_attr(a) != "auto", F.lit(False))
    said = rows.filter(F.col("parent_tag").isin("style:style", "style:default-style")).groupBy(
        "doc_id", "part", F.col("parent_id").alias("node_id")
    ).agg(
        F.max(language("fo:language")).alias("western"), F.max(language("style:language-asian")).alias("asian"),
        F.max(language("style:language-complex")).alias("complex"),
        F.max(F.when((_attr("table:display") == "false") | (_attr("presentation:visibility") == "hidden"), "true")).alias("hidden"),
        F.max(F.when(breaks("fo:break-before") | breaks("fo:break-after"), "true")).alias("breaks"),
        F.bool_or(F.col("tag") == "style:map").alias("conditional"),
    )
    joined = named.join(said, kept, "left")
    pairs = [c for p in ("western", "asian", "complex", "hidden") for c in (F.lit(p), F.col(p))]
    props = F.map_filter(
        F.create_map(*pairs, F.lit("breaks"), F.coalesce("breaks", F.when(F.col("__page"), "true"))), lambda _, v: v.isNotNull()
    )
    return joined.select("doc_id", "family", "name", "parent", F.coalesce("conditional", F.lit(False)).alias("conditional"), props.alias("props"))


def effective(nodes: DataFrame) -> DataFrame:
    """doc_id, family, style, parent, status, props of every style, its parents and its family's default applied.

    The style "" of a family is the default alone; every document has one for paragraphs.
    """
    whole = stored(styles_of(nodes))
    named = whole.filter("name IS NOT NULL")
    found = graph.resolve_chains(named, ["doc_id", "family", "name"], "parent", props="props")
    parents = named.groupBy("doc_id", "family", "name").agg(F.min("parent").alias("parent"))
    empty = F.expr("cast(map() as map<string,string>)")
    defaults = whole.filter("name IS NULL").groupBy("doc_id", "family").agg(F.any_value("props").alias("__default"))
    docs = nodes.select("doc_id", F.lit("paragraph").alias("family")).distinct()
    bare = docs.join(defaults, ["doc_id", "family"], "left").select(
        "doc_id", "family", F.lit("").alias("style"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("status"),
        F.coalesce("__default", empty).alias("props"),
    )
    own = found.join(parents, ["doc_id", "family", "name"]).join(defaults, ["doc_id", "family"], "left")
    missing = F.map_filter(F.coalesce("__default", empty), lambda k, _: ~F.array_contains(F.map_keys("props"), k))
    return own.filter("name <> ''").select(
        "doc_id", "family", F.col("name").alias("style"), "parent", "status", F.map_concat("props", missing).alias("props")
    ).unionByName(bare)


def style_findings(nodes: DataFrame, said: DataFrame, styles: DataFrame) -> DataFrame:
    """LANG001 and LANG002 of paragraphs with words, STYLE001 of documents that use unresolved styles."""
    blocks = odf.body(nodes).filter("flow").filter(F.col("tag").isin("text:p", "text:h")).select(
        "doc_id", "node_id", "tag", F.coalesce(_attr("text:style-name"), F.lit("")).alias("style")
    )
    paragraph = styles.filter("family = 'paragraph'")
    shown = blocks.join(said.filter(~is_blank(F.col("words"))).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
    channels = [F.col("props")[c].alias(c) for c in ("western", "asian", "complex")]
    spoken = documents.audit_languages(shown, paragraph.select("doc_id", "style", F.lit(True).alias("known"), "status", *channels))
    usage = documents.style_usage(blocks, paragraph.select("doc_id", "style", "parent", "status"), ["doc_id", "style"])
    lost = usage.filter("problem IS NOT NULL")
    listed = first_list(lost.select("doc_id", "style"), ["doc_id"], ["style"], F.col("style"), "styles")
    pos = F.col("node_id")
    path = F.concat(F.lit("content/"), F.when(F.col("tag") == "text:h", "heading").otherwise("paragraph"), F.lit("["), pos.cast("string"), F.lit("]"))
    silent, unresolved = spoken.filter("rule_id = 'LANG001'"), spoken.filter("rule_id = 'LANG002'")
    return fo.union_findings(
        fo.raise_rule(silent, "LANG001", path=path, pos=pos, kind="language.target"),
        fo.raise_rule(unresolved, "LANG002", path=path, pos=pos),
        fo.raise_rule(listed, "STYLE001", path=F.lit("styles"), details={"styles": F.array_join("styles", ", ")}),
    )


def hidden_findings(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """ORDER003: sheets, rows, columns and pages hidden by a style or their own state, and layers not shown."""
    kinds = {"table:table": ("sheet", "table"), "table:table-row": ("table-row", "table-row"),
             "table:table-column": ("table-column", "table-column"), "draw:page": ("page", "drawing-page")}
    pick = lambda i: F.coalesce(*[F.when(F.col("tag") == t, v[i]) for t, v in kinds.items()])
    body = odf.body(nodes)
    sheet = (F.col("tag") != "table:table") | (F.col("parent_tag") == "office:spreadsheet")
    items = body.filter(F.col("tag").isin(list(kinds)) & sheet).select(
        "doc_id", pick(0).alias("class"), pick(1).alias("family"), F.coalesce(_attr("table:style-name"), _attr("draw:style-name")).alias("name"),
        _attr("table:visibility").alias("state"),
    )
    layers = nodes.filter("problem IS NULL AND tag = 'draw:layer'").select(
        "doc_id", F.lit("layer").alias("class"), F.lit("layer").alias("family"), F.lit(None).cast("string").alias("name"), _attr("draw:display").alias("state")
    )
    key = F.concat_ws("/", "family", "name").alias("style")
    told = styles.select("doc_id", F.concat_ws("/", "family", "style").alias("style"), F.coalesce(F.col("props")["hidden"] == "true", F.lit(False)).alias("hidden"))
    counted = documents.hidden_content(items.unionByName(layers).select("doc_id", "class", key, "state"), told)
    return fo.union_findings(fo.raise_rule(counted, "ORDER003", details={"class": F.col("class"), "count": F.col("n")}))


def range_findings(nodes: DataFrame) -> DataFrame:
    """REF003: bookmarks and reference marks whose ends do not match."""
    tags = {f"text:{k}{end}": (k, mark) for k in ("bookmark", "reference-mark") for end, mark in (("", "point"), ("-start", "start"), ("-end", "end"))}
    pick = lambda i: F.coalesce(*[F.when(F.col("tag") == t, v[i]) for t, v in tags.items()])
    marks = odf.body(nodes).filter("flow").filter(F.col("tag").isin(list(tags))).select(
        "doc_id", pick(0).alias("kind"), F.coalesce(_attr("text:name"), F.lit("")).alias("name"), pick(1).alias("mark"), F.col("node_id").alias("pos"), "context"
    )
    wrong = references.pair_ranges(marks, ["doc_id", "kind", "name"]).filter("n_findings > 0")
    details = {"name": F.col("name"), "kind": F.col("kind"), "count": F.col("n_findings")}
    return fo.union_findings(fo.raise_rule(wrong, "REF003", path=F.lit("content"), details=details))


def resource_findings(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """NATIVE001: packages that load what is not in them; NATIVE002: fields that show the file's own name."""
    body = odf.body(nodes)
    loads = body.filter(F.col("tag").isin(list(RESOURCES))).filter(F.coalesce(_attr("xlink:href") != "", F.lit(False)))
    packed = loads.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    folder = F.coalesce(*[F.when(F.col("tag") == t, f) for t, f in RESOURCES.items()])
    hrefs = packed.select("doc_id", _attr("xlink:href").alias("href"), local_resource(_attr("xlink:href")).alias("member"), folder.alias("folder"))
    missing = references.missing_resources(hrefs, members).groupBy("doc_id").agg(F.count("*").alias("n"))
    fields = body.filter("flow AND tag = 'text:file-name'").groupBy("doc_id").agg(F.count("*").alias("n"))
    count = {"count": F.col("n")}
    return fo.union_findings(fo.raise_rule(missing, "NATIVE001", details=count), fo.raise_rule(fields, "NATIVE002", details=count))
