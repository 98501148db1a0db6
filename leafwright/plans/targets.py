"""The elements a question can be about: canonical paths and fingerprints of their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.functions.identity import row_weight
from leafwright.operators.context import with_context
from leafwright.operators.nesting import with_owners
from leafwright.operators.sequence import ordinal
from leafwright.plans import nodes as odf

# Elements by the kind their path names, and what an answer may change in them.
KINDS = {
    "text:h": "heading", "text:p": "paragraph", "text:a": "link", "draw:a": "link", "draw:frame": "frame",
    "table:table": "table", "draw:page": "page", "text:list": "list", "text:section": "section",
    "text:note": "note", "office:chart": "chart",
}
ANSWERABLE = ["text:outline-level", "office:title", "draw:decorative", "table:name", "draw:name", "draw:nav-order"]
EXCERPT = 200  # characters
ANSWERED_ELEMENTS = ["svg:title", "svg:desc"]


def targets(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, target_path, target_fingerprint of every element that a question can name.

    A path is the element's place among those of its kind, ``content/heading[3]``, so it does not move with
    edits of other kinds.  A fingerprint is a digest of all that is in the element, less what an answer may
    change; it is a sum over the element's nodes, so an element of any size is summed where its nodes are.
    """
    rows = nodes.filter("problem IS NULL AND part = 'content'")
    tag, attrs = F.col("tag"), F.col("attrs")
    kind = F.coalesce(*[F.when(tag == t, k) for t, k in KINDS.items()])
    sheet = (tag == "table:table") & (F.col("parent_tag") == "office:spreadsheet")
    listed = rows.withColumn("__kind", F.when(F.coalesce(sheet, F.lit(False)), "sheet").otherwise(kind))
    placed = ordinal(listed.filter("__kind IS NOT NULL").select("doc_id", "node_id", "__kind"), ["doc_id", "__kind"], "node_id", "__n")
    path = F.concat(F.lit("content/"), F.col("__kind"), F.lit("["), F.col("__n").cast("string"), F.lit("]"))
    kept = F.map_filter(attrs, lambda k, _: ~k.isin(ANSWERABLE))
    body = F.to_json(
        F.struct("tag", F.sort_array(F.map_entries(kept)).alias("attrs"), F.coalesce("text", F.lit("")).alias("text"))
    )
    content = listed.filter(~tag.isin(ANSWERED_ELEMENTS)).select(
        "doc_id", "part", "node_id", "last_id", "tag", "__kind", body.alias("__body"), F.coalesce("tail", F.lit("")).alias("__tail")
    )
    inside = with_owners(content, F.col("__kind").isNotNull())
    # A node counts with its place in the element; what follows the element itself is not in it.
    at = (F.col("node_id") - F.col("owner_id")).cast("string")
    own = F.col("node_id") == F.col("owner_id")
    weight = row_weight(F.concat_ws("\x1f", at, "__body", F.when(~own, F.col("__tail")).otherwise("")))
    summed = inside.groupBy("doc_id", F.col("owner_id").alias("node_id")).agg(F.sum(weight).alias("__sum"))
    mark = F.substring(F.sha2(F.col("__sum").cast("string"), 256), 1, 16)
    return placed.join(summed, ["doc_id", "node_id"]).select(
        "doc_id", "node_id", path.alias("target_path"), mark.alias("target_fingerprint")
    )


def named(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings about an element with its canonical path and, where they ask a question, its fingerprint."""
    known = targets(nodes).withColumnRenamed("node_id", "pos")
    joined = findings.join(known, ["doc_id", "pos"], "left")
    about = F.col("target_path").isNotNull() & F.col("path").isNotNull()
    values = {
        "path": F.when(about, F.col("target_path")).otherwise(F.col("path")),
        "fingerprint": F.when(about & F.col("kind_id").isNotNull(), F.col("target_fingerprint")).otherwise(F.col("fingerprint")),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in findings.columns])


def landmarks(nodes: DataFrame) -> DataFrame:
    """doc_id, pos, kind (page, sheet, heading), name: what a reader knows a place by."""
    rows = odf.body(nodes)
    tag, attrs = F.col("tag"), F.col("attrs")
    pages = rows.filter("tag = 'draw:page'").select("doc_id", F.col("node_id").alias("pos"), F.lit("page").alias("kind"), attrs["draw:name"].alias("name"))
    sheets = rows.filter((tag == "table:table") & (F.col("parent_tag") == "office:spreadsheet")).select(
        "doc_id", F.col("node_id").alias("pos"), F.lit("sheet").alias("kind"), attrs["table:name"].alias("name")
    )
    heads = rows.filter("flow AND tag = 'text:h'").join(odf.words(nodes, ["text:h"]), ["doc_id", "node_id"], "left").select(
        "doc_id", F.col("node_id").alias("pos"), F.lit("heading").alias("kind"), F.coalesce("words", F.lit("")).alias("name")
    )
    return pages.unionByName(sheets).unionByName(heads)


def question_context(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """The findings that ask a question, with page, sheet, heading and an excerpt of the element's words."""
    nodes = odf.document_nodes(corpus)
    said = odf.words(nodes, list(KINDS)).select("doc_id", F.col("node_id").alias("pos"), F.left("words", F.lit(EXCERPT)).alias("excerpt"))
    return with_context(findings.filter("kind_id IS NOT NULL"), landmarks(nodes), ["page", "sheet", "heading"], said)
