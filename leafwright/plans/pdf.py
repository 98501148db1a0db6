"""Audit of extracted PDF structure tables (see FIXTURES.md for their layout)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.operators import documents, graph, references, structure
from leafwright.operators import findings as fo
from leafwright.operators.sequence import first_list
from leafwright.session import stored


def _heading_rows(nodes: DataFrame) -> DataFrame:
    level = F.regexp_extract("role", "^H([0-9])$", 1)
    return nodes.filter(level != "").select(
        "doc_id", F.col("node_id").alias("pos"), F.try_to_number(level, F.lit("9")).cast("int").alias("level")
    )


def audit_pdf(
    docs: DataFrame,
    nodes: DataFrame,
    refs: DataFrame,
    annots: DataFrame,
    streams: DataFrame,
    role_map: DataFrame | None = None,
) -> DataFrame:
    """Findings of tagged documents.

    ``docs``: one metadata row each (title, language, marked, ...).  ``nodes``: doc_id, node_id in
    document order, parent_id, raw_role, alt, page_ref, ancestors (ids, itself included).
    ``refs``: doc_id, node_id, object_ref, stream_ref, page_ref, mcid.  ``annots``: doc_id,
    annot_ref, page_ref, contents.  ``streams``: doc_id, stream_ref, mcids, graphical_mcids,
    unmarked_text_ops.  Without ``role_map`` raw roles are taken as they are.
    """
    standard = F.when(F.col("raw_role").isin(graph.STANDARD_ROLES), F.col("raw_role"))
    if role_map is not None:
        mapped = graph.resolve_roles(role_map).withColumnRenamed("role", "raw_role")
        nodes = nodes.join(mapped, ["doc_id", "raw_role"], "left")
        standard = F.coalesce(standard, F.col("standard_role"))
    nodes = stored(nodes.withColumn("role", standard))
    custom = nodes.filter("role IS NULL").select("doc_id", "raw_role").distinct()
    unmapped = first_list(custom, ["doc_id"], ["raw_role"], F.col("raw_role"), "roles")
    heads = _heading_rows(nodes)
    checked = structure.heading_hierarchy(heads)
    skips = structure.tagged_heading_skips(checked)
    parents = structure.attach_parent(nodes, ["role"])
    wrong = structure.child_roles(parents.filter("role IS NOT NULL AND parent_role IS NOT NULL"))
    tables = nodes.filter("role = 'Table'").select("doc_id", F.col("node_id").alias("table_id"))
    below = nodes.select("doc_id", "node_id", "role", F.explode("ancestors").alias("table_id")).filter("node_id <> table_id")
    bare = structure.table_headers(below.join(tables, ["doc_id", "table_id"], "left_semi"), "table_id", "TR", "TH")
    links = nodes.filter("role = 'Link'").select("doc_id", "node_id", "alt")
    elements = links.join(
        refs.select("doc_id", "node_id", "object_ref", "page_ref"), ["doc_id", "node_id"], "left"
    )
    linked = references.link_structure(annots, elements)
    content = streams.select("doc_id", "stream_ref", F.explode("mcids").alias("mcid"))
    marked = references.reconcile_content(content, refs.filter("mcid IS NOT NULL"))
    per_rule = marked.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))
    loose = references.unmarked_text(streams).groupBy("doc_id").agg(F.sum("unmarked_text_ops").alias("n"))
    graphical = streams.select("doc_id", "stream_ref", F.explode("graphical_mcids").alias("mcid"))
    painted = refs.join(graphical, ["doc_id", "stream_ref", "mcid"], "left_semi").select("doc_id", "node_id")
    figures = nodes.filter("role = 'Figure'").select("doc_id", "node_id", "alt")
    shown = graph.described_graphics(figures, nodes.join(painted.distinct(), ["doc_id", "node_id"], "left_semi"))
    counts = shown.groupBy("doc_id").agg(F.count("*").alias("described_graphics"))
    meta = documents.audit_pdf_meta(
        docs.join(counts, "doc_id", "left").withColumn("described_graphics", F.coalesce("described_graphics", F.lit(0)))
    )
    rule, found = F.col("rule_id"), fo.raise_rule
    count = {"count": F.col("n")}
    return fo.union_findings(
        found(meta, rule),
        found(unmapped, "PDF012", details={"unmapped_structure_types": F.array_join("roles", ",")}),
        found(structure.without_headings(docs.select("doc_id"), heads), "PDF009"),
        found(skips.filter("start_level IS NOT NULL"), "PDF013", details={"level": F.col("start_level")}),
        found(skips.filter("n_skips > 0"), "PDF025", details={"skips": F.array_join("skips", ",")}),
        found(wrong, rule, details={"parent": F.col("parent_role"), "child": F.col("role"), **count}),
        found(bare, "PDF016", details={"rows": F.col("rows")}),
        found(references.figures(nodes), "PDF008", details={"missing": F.col("n_missing")}),
        found(linked, rule, details=count),
        found(per_rule, rule, details=count),
        found(loose, "PDF024", details=count),
    )
