"""OpenDocument node rows and the tables the checks read, projected from them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.nesting import with_enclosing, with_owners
from leafwright.session import stored
from leafwright.sources.corpus import ROW_BYTES
from leafwright.sources.xml import shred_xml

# Package members by logical part, word separators and content nobody reads.
PARTS = {
    "content": "content.xml",
    "styles": "styles.xml",
    "meta": "meta.xml",
    "settings": "settings.xml",
    "manifest": "META-INF/manifest.xml",
}
SEPARATORS = ["text:s", "text:tab", "text:line-break", "text:p", "text:h"]
HIDDEN = ["svg:title", "svg:desc", "office:binary-data"]
EXCLUDED = ["office:annotation", "text:tracked-changes", "text:hidden-text", "text:conditional-text"]
BOUNDARIES = ["table:table-cell", "table:covered-table-cell", "draw:text-box"]
# What a check asks for above a node; every other element leaves no mark on what is below it.
WATCHED = [
    *EXCLUDED, *HIDDEN, *BOUNDARIES, "office:body", "office:spreadsheet", "office:chart", "office:image", "office:scripts",
    "office:database", "office:automatic-styles", "text:note", "text:a", "text:list", "text:list-item", "text:section", "text:event-listeners",
    "draw:page", "draw:a", "draw:control", "form:control", "form:event-listeners", "office:event-listeners", "script:event-listener",
    "table:table", "table:table-header-rows", "table:table-header-columns", "chart:title", "math:annotation",
    "math:annotation-xml", "math:mphantom", "db:query-collection", "db:component-collection", "db:table-representation",
]
HIDING = "#hidden"  # the mark of a section or paragraph that is hidden with what is in it
UNKNOWN = "{"  # the mark of an element of another namespace
PARTS_SCHEMA = "doc_id string, part string, content binary"
_FLUSH_BYTES = 64 << 20  # unpacked bytes handed back to Spark at once


def is_package(content: Column) -> Column:
    return F.substring(F.hex(F.substring(content, 1, 4)), 1, 8) == "504B0304"


def document_parts(corpus: DataFrame) -> DataFrame:
    """Logical parts: members of a package, or the one tree of a flat document as ``content``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        names = {i.filename for i in archive.infolist() if i.file_size <= ROW_BYTES}
                        for part, name in PARTS.items():
                            if name in names:
                                rows.append((doc_id, part, archive.read(name)))
                                size += len(rows[-1][2])
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError):
                    continue  # the member inventory reports it
                if size >= _FLUSH_BYTES:
                    yield pd.DataFrame(rows, columns=["doc_id", "part", "content"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "part", "content"])

    data = corpus.filter("admitted").select("doc_id", F.col("content").cast("binary").alias("content"))
    packed = data.filter(is_package(F.col("content"))).mapInPandas(read, PARTS_SCHEMA)
    flat = data.filter(~is_package(F.col("content"))).select("doc_id", F.lit("content").alias("part"), "content")
    return packed.unionByName(flat)


def _hides() -> Column:
    """Whether a section hides what is in it, at once or on a condition, or a paragraph holds a field that does."""
    attr = lambda n: F.col("attrs")[n]
    section = attr("text:display").isin("none", "condition") | attr("text:condition").isNotNull()
    return ((F.col("tag") == "text:section") & F.coalesce(section, F.lit(False))) | F.col("held")


def placed(nodes: DataFrame) -> DataFrame:
    """Node rows with parent_tag, nearest and level (see ``operators.nesting``), and ``held``: whether a
    paragraph holds a field that hides it.  Documents that could not be read keep their row."""
    key = ["doc_id", "part"]
    fields = nodes.filter("tag = 'text:hidden-paragraph'").select(*key).distinct()
    some = nodes.join(fields, key, "left_semi").select(*key, "node_id", "last_id", "tag")
    # a field hides the innermost paragraph around it
    held = with_owners(some, F.col("tag").isin("text:p", "text:h")).filter("tag = 'text:hidden-paragraph'").groupBy(*key, "node_id").agg(
        F.max("owner_id").alias("owner")
    ).select(*key, F.col("owner").alias("node_id"), F.lit(True).alias("held")).distinct()
    rows = nodes.filter("problem IS NULL").join(held, [*key, "node_id"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    mark = lambda test, name: F.when(test, name)
    marks = F.array_compact(
        F.array(
            mark(F.col("tag").isin(WATCHED), F.col("tag")), mark(F.col("tag").startswith("{"), F.lit(UNKNOWN)), mark(_hides(), F.lit(HIDING))
        )
    )
    known = with_enclosing(rows, marks, "text:list", BOUNDARIES)
    return known.unionByName(nodes.filter("problem IS NOT NULL"), allowMissingColumns=True)


def document_nodes(corpus: DataFrame) -> DataFrame:
    """All node rows of a corpus, shredded once and stored for the checks that read them."""
    return stored(placed(stored(shred_xml(document_parts(corpus)))))


def nearest(*tags: str) -> Column:
    """The id of the innermost element above with one of the tags; null without one."""
    ids = [F.col("nearest")[t] for t in tags]
    return F.greatest(*ids) if len(ids) > 1 else ids[0]


def above(tag: str) -> Column:
    return F.col("nearest")[tag].isNotNull()


def in_flow(tag: Column | None = None) -> Column:
    """Whether no ancestor, nor an element of that tag itself, leaves the current reading flow."""
    out = F.arrays_overlap(F.map_keys("nearest"), F.array(*[F.lit(t) for t in (*EXCLUDED, UNKNOWN, HIDING)]))
    return ~out if tag is None else ~out & ~tag.isin(EXCLUDED) & ~tag.startswith("{")


def body(nodes: DataFrame) -> DataFrame:
    """Readable nodes of the body with the tags above them, their level and reading context."""
    owners = ["text:note", "draw:text-box", "draw:page", "table:table"]
    rows = nodes.filter("problem IS NULL AND part = 'content'").filter(above("office:body"))
    owner = nearest(*owners)
    kind = F.coalesce(*[F.when(F.col("nearest")[t] == owner, t) for t in owners])
    place = F.concat(F.split_part(kind, F.lit(":"), F.lit(-1)), F.lit("["), owner, F.lit("]"))
    own_context = owner.isNotNull() & ((kind != "table:table") | above("office:spreadsheet"))
    context = F.when(own_context, F.concat(F.lit("content/"), place)).otherwise("content")
    return (
        rows.withColumn("above", F.map_keys("nearest")).withColumn("context", context)
        .withColumn("hidden", above(HIDING) | _hides()).withColumn("flow", in_flow(F.col("tag")) & ~_hides())
    )


def words(nodes: DataFrame, owners: list[str]) -> DataFrame:
    """Visible words of every element whose tag is listed: doc_id, node_id, words.

    Each text piece is sent to the owners above it and joined in reading order: a text counts at
    its node, a tail after the node's last descendant.
    """
    from leafwright.functions.text import visible_words

    rows = nodes.filter("problem IS NULL AND part = 'content'")
    shown = ~F.col("tag").isin(HIDDEN) & ~F.arrays_overlap(F.map_keys("nearest"), F.array(*[F.lit(t) for t in HIDDEN]))
    gap = F.when(F.col("tag").isin(SEPARATORS), " ").otherwise("")
    said = F.when(shown, F.concat(gap, F.coalesce("text", F.lit("")))).otherwise("")
    pieces = rows.select(
        "doc_id", "part", "node_id", "last_id", "tag", "depth", said.alias("said"), F.coalesce("tail", F.lit("")).alias("tail")
    )
    # Only what says something, and the owners themselves, go through the join.
    pieces = pieces.filter((F.col("said") != "") | (F.col("tail") != "") | F.col("tag").isin(owners))
    sent = with_owners(pieces, F.col("tag").isin(owners))
    piece = lambda at, late, deep, text: F.struct(at.alias("at"), F.lit(late).alias("late"), deep.alias("deep"), text.alias("piece"))
    text = piece(F.col("node_id"), 0, F.lit(0), F.col("said"))
    tail = F.when(F.col("owner_id") != F.col("node_id"), piece(F.col("last_id"), 1, -F.col("depth"), F.col("tail")))
    listed = sent.select("doc_id", "owner_id", F.explode(F.array_compact(F.array(text, tail))).alias("p")).filter("p.piece <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda s: s["piece"]), "")
    return listed.groupBy("doc_id", F.col("owner_id").alias("node_id")).agg(visible_words(joined).alias("words"))


def lists_of(nodes: DataFrame) -> DataFrame:
    """Lists in the layout the continuation check reads."""
    rows = body(nodes).filter("tag = 'text:list' AND flow")
    domain = F.concat_ws("#", "context", nearest(*BOUNDARIES).cast("string"))
    return rows.select(
        "doc_id", F.col("node_id").alias("list_id"), domain.alias("context"),
        "level",
        F.col("attrs")["text:style-name"].alias("style"), F.col("attrs")["xml:id"].alias("xml_id"),
        F.col("attrs")["text:continue-list"].alias("continue_list"),
        F.col("attrs")["text:continue-numbering"].alias("continue_numbering"),
    )


def anchors_of(nodes: DataFrame) -> DataFrame:
    """Destinations: bookmarks, reference marks, notes and anything a link can name."""
    attr = lambda n: F.col("attrs")[n]
    tag = F.col("tag")
    mark = F.when(tag.isin("text:bookmark", "text:bookmark-start"), "bookmark").when(
        tag.isin("text:reference-mark", "text:reference-mark-start"), "reference-mark"
    )
    named = (
        F.when(tag.isin("text:a", "draw:a"), attr("office:name")).when(tag == "text:section", attr("text:name"))
        .when(tag == "table:table", attr("table:name")).when(tag == "draw:frame", attr("draw:name"))
    )
    entry = lambda when, kind, name: F.when(when, F.struct(kind.alias("kind"), name.alias("name")))
    link = F.lit("link")
    found = F.array_compact(
        F.array(
            entry(mark.isNotNull(), mark, F.coalesce(attr("text:name"), F.lit(""))),
            entry(mark.isNotNull(), link, F.coalesce(attr("text:name"), F.lit(""))),
            entry(tag == "text:note", F.lit("note"), F.coalesce(attr("text:id"), F.lit(""))),
            entry(F.coalesce(attr("xml:id") != "", F.lit(False)), link, attr("xml:id")),
            entry(F.coalesce(named != "", F.lit(False)), link, named),
        )
    )
    rows = body(nodes).select(
        "doc_id", "node_id", F.col("flow").alias("in_flow"), attr("text:note-class").alias("note_class"),
        F.explode(F.array_distinct(found)).alias("e"),
    )
    return rows.select("doc_id", "node_id", "in_flow", "note_class", "e.kind", "e.name")


def refs_of(nodes: DataFrame) -> DataFrame:
    """References: typed fields and links to a fragment of their own document."""
    from leafwright.functions.names import unquote

    attr = lambda n: F.col("attrs")[n]
    tag, href = F.col("tag"), attr("xlink:href")
    field = (
        F.when(tag == "text:bookmark-ref", "bookmark").when(tag == "text:reference-ref", "reference-mark")
        .when(tag == "text:note-ref", "note")
    )
    local = tag.isin("text:a", "draw:a") & href.startswith("#") & (F.length(href) > 1)
    kind = F.coalesce(field, F.when(local, "link"))
    name = F.when(field.isNotNull(), F.coalesce(attr("text:ref-name"), F.lit(""))).otherwise(unquote(F.substr(href, F.lit(2))))
    rows = body(nodes).filter("flow").withColumn("kind", kind).filter("kind IS NOT NULL")
    return rows.select("doc_id", F.col("node_id").alias("pos"), "context", "kind", name.alias("name"), attr("text:note-class").alias("note_class"))
