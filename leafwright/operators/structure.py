"""Document structure: headings, ordinals, lists, runs, parents and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.sequence import (
    BLOCK,
    first_list,
    last_known,
    ordinal,
    previous,
    running_sum,
    scan,
)
from leafwright.session import literal_frame

MAX_HEADING_LEVEL = 10

# The roles a structure element may hold.
ALLOWED_CHILDREN = {
    "L": ["LI", "L", "Caption"],
    "LI": ["Lbl", "LBody"],
    "Table": ["TR", "THead", "TBody", "TFoot", "Caption"],
    "THead": ["TR"],
    "TBody": ["TR"],
    "TFoot": ["TR"],
    "TR": ["TH", "TD"],
}
LIST_ROLES = ["L", "LI"]


def valid_level(level: Column) -> Column:
    return F.coalesce(level.between(1, MAX_HEADING_LEVEL), F.lit(False))


def heading_hierarchy(
    headings: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", block=BLOCK
) -> DataFrame:
    """HEADING001-003 per heading.

    An invalid level is reported and then ignored: the next heading is compared with the last
    valid one.  The scan carries that level, so no document is ordered in a single task.
    """
    ok = valid_level(F.col(level))
    seen = scan(
        headings, [doc], pos, {"__prev": last_known(F.when(ok, F.col(level)), inclusive=False)}, block
    )
    before = F.col("__prev")
    rule = (
        F.when(~ok, "HEADING001")
        .when(before.isNull() & (F.col(level) > 1), "HEADING002")
        .when(F.col(level) > before + 1, "HEADING003")
    )
    return seen.withColumn("rule_id", rule).withColumnRenamed("__prev", "previous_level")


def without_headings(docs: DataFrame, headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents that hold no heading at all (HEADING005)."""
    return docs.join(headings.select(doc).distinct(), doc, "left_anti")


def tagged_heading_skips(checked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: skips counted and the first eight listed (PDF013, PDF025)."""
    skips = checked.filter(F.col("rule_id") == "HEADING003")
    text = F.concat(F.lit("H"), F.col("previous_level"), F.lit(" to H"), F.col("level"))
    counted = checked.groupBy(doc).agg(
        F.count_if(F.col("rule_id") == "HEADING003").alias("n_skips"),
        F.max(F.when(F.col("rule_id") == "HEADING002", F.col("level"))).alias("start_level"),
    )
    return counted.join(first_list(skips, [doc], ["pos"], text, "skips"), doc, "left")


def context_ordinals(nodes: DataFrame, keys: list[str], pos: str, block=BLOCK) -> DataFrame:
    """1-based ordinal of each kind in its reading context."""
    return ordinal(nodes, keys, pos, "ordinal", block)


def logical_runs(decl: DataFrame, keys: list[str], pos: str, repeat: str, block=BLOCK) -> DataFrame:
    """First and last logical position of each repeated declaration, without expanding it."""
    ended = scan(decl, keys, pos, {"run_end": running_sum(F.col(repeat).cast("long"))}, block)
    return ended.withColumn("run_start", F.col("run_end") - F.col(repeat) + 1)


def leading_headers(
    rows: DataFrame, keys: list[str], pos: str, is_header: Column, repeat: str, block=BLOCK
) -> DataFrame:
    """Logical header rows before the first data row, and headers that come later."""
    first_data = rows.groupBy(*keys).agg(
        F.min(F.when(~is_header, F.col(pos))).alias("__data"),
    )
    # One row per group on the right, so a long table stays spread over many tasks.
    tagged = rows.join(first_data, keys)
    leading = is_header & (F.col("__data").isNull() | (F.col(pos) < F.col("__data")))
    return tagged.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(leading, F.col(repeat))), F.lit(0)).cast("long").alias("leading"),
        F.count_if(is_header & ~leading).alias("non_leading"),
    )


def previous_peer(
    lists: DataFrame, keys: list[str], pos: str, ident: str, style: str, block=BLOCK
) -> DataFrame:
    """The nearest earlier list with the same key; a null style never matches."""
    found = scan(lists, [*keys, style], pos, {"peer": previous(F.col(ident))}, block)
    return found.withColumn("peer", F.when(F.col(style).isNotNull(), F.col("peer")))


def trailing_empty(seq: DataFrame, doc: str, pos: str, empty: Column) -> DataFrame:
    """Empty items after the last filled one; the first item stays if all are empty."""
    kept = seq.groupBy(doc).agg(
        F.coalesce(F.max(F.when(~empty, F.col(pos))), F.min(pos)).alias("__kept")
    )
    return seq.join(kept, doc).filter(empty & (F.col(pos) > F.col("__kept"))).drop("__kept")


def list_level(ancestors: Column, list_tag: str, boundaries: list[str]) -> Column:
    """Counter level from an outermost-first ancestor tag array, reset at a boundary."""
    return F.aggregate(
        ancestors,
        F.lit(1).cast("long"),
        lambda acc, tag: F.when(tag.isin(boundaries), F.lit(1).cast("long")).otherwise(
            acc + F.when(tag == list_tag, 1).otherwise(0)
        ),
    )


def list_membership(nodes: DataFrame, list_tag: str, item: str, header: str) -> DataFrame:
    """Per list: foreign children, header count and place, list directly in a list, bad boolean.

    ``nodes`` holds doc_id, node_id, parent_id, parent_tag, ord, tag and continue_numbering.
    """
    children = (
        nodes.filter(F.col("parent_tag") == list_tag)
        .groupBy("doc_id", F.col("parent_id").alias("node_id"))
        .agg(
            F.count("*").alias("n_children"),
            F.count_if(~F.col("tag").isin(item, header)).alias("n_foreign"),
            F.count_if(F.col("tag") == header).alias("n_headers"),
            F.min_by("tag", "ord").alias("first_tag"),
        )
    )
    lists = nodes.filter(F.col("tag") == list_tag).select(
        "doc_id", "node_id", "parent_tag", "continue_numbering"
    )
    joined = lists.join(children, ["doc_id", "node_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    bad = (
        (zero(F.col("n_foreign")) > 0)
        | (zero(F.col("n_headers")) > 1)
        | ((zero(F.col("n_headers")) == 1) & (F.col("first_tag") != header))
    )
    numbering = F.col("continue_numbering")
    return joined.select(
        "doc_id",
        "node_id",
        zero(F.col("n_children")).alias("n_children"),
        bad.alias("list002"),
        F.coalesce(F.col("parent_tag") == list_tag, F.lit(False)).alias("list003"),
        F.coalesce(~numbering.isin("true", "false", "1", "0"), F.lit(False)).alias("list004"),
    )


def continuations(lists: DataFrame, block=BLOCK) -> DataFrame:
    """Continuation edge of every list and LIST006-LIST008.

    ``lists``: doc_id, list_id (long, document order), context, level, style, xml_id,
    continue_list, continue_numbering.  An explicit reference must name exactly one list; an
    implicit one takes the nearest earlier list of the same context, level and style.
    """
    targets = (
        lists.filter(F.col("xml_id").isNotNull())
        .groupBy("doc_id", F.col("xml_id").alias("continue_list"))
        .agg(
            F.count("*").alias("__n"),
            F.min("list_id").alias("__to"),
            F.min("context").alias("__context"),
            F.min("level").alias("__level"),
        )
    )
    peers = previous_peer(lists, ["doc_id", "context", "level"], "list_id", "list_id", "style", block)
    joined = peers.join(targets, ["doc_id", "continue_list"], "left")
    explicit = F.coalesce(F.col("continue_list") != "", F.lit(False))
    found = F.coalesce(F.col("__n") == 1, F.lit(False))
    implicit = ~explicit & F.coalesce(F.col("continue_numbering").isin("true", "1"), F.lit(False))
    crossing = (F.col("__context") != F.col("context")) | (F.col("__level") != F.col("level"))
    rule = (
        F.when(explicit & ~found, "LIST006")
        .when(explicit & crossing, "LIST007")
        .when(implicit & F.col("peer").isNull(), "LIST008")
    )
    target = F.when(explicit & found, F.col("__to")).when(implicit, F.col("peer"))
    return joined.select("doc_id", "list_id", target.alias("continues"), rule.alias("rule_id"))


def child_roles(nodes: DataFrame) -> DataFrame:
    """Children a parent's role does not allow: (document, parent role, child role, count)."""
    spark = nodes.sparkSession
    pairs = [(p, c) for p, found in ALLOWED_CHILDREN.items() for c in found]
    allowed = literal_frame(spark, pairs, "parent_role string, role string")
    pairs_seen = (
        nodes.filter(F.col("parent_role").isin(list(ALLOWED_CHILDREN)))
        .groupBy("doc_id", "parent_role", "role")
        .agg(F.count("*").alias("n"))
    )
    wrong = pairs_seen.join(allowed, ["parent_role", "role"], "left_anti")
    rule = F.when(F.col("parent_role").isin(LIST_ROLES), "PDF014").otherwise("PDF015")
    return wrong.withColumn("rule_id", rule)


def attach_parent(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Parent columns as ``parent_<name>``; node ids are unique, so one side never repeats a key."""
    parents = nodes.select(
        "doc_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in columns]
    )
    return nodes.join(parents, ["doc_id", "parent_id"], "left")


def table_headers(nodes: DataFrame, table: str, row: str, header: str) -> DataFrame:
    """PDF016: tables with two rows or more and no header cell.

    ``nodes`` holds one row per (table ancestor, node); ancestors are exploded, never walked.
    """
    return (
        nodes.groupBy("doc_id", table)
        .agg(
            F.count_if(F.col("role") == row).alias("rows"),
            F.bool_or(F.col("role") == header).alias("has_header"),
        )
        .filter((F.col("rows") >= 2) & ~F.col("has_header"))
    )


def inside(nodes: DataFrame, doc: str, pos: str, opens: Column, closes: Column, name: str) -> DataFrame:
    """Whether each tag event lies inside an open element (the opening event included)."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0).cast("long")
    counted = scan(nodes, [doc], pos, {"__open": running_sum(step)})
    return counted.withColumn(name, (F.col("__open") > 0) | closes).drop("__open")
