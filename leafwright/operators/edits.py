"""Typed edits that insert, drop and regroup rows of a document without renumbering it.

A row's place is an array of numbers, compared from the left; a paragraph starts with ``[n]``.  What an edit
puts between two neighbours gets a place between theirs, and no other row is touched, so an edit of one
paragraph of a huge document writes that paragraph.  Each edit returns the candidate rows, the rows it was
allowed to create, change or remove (for ``update.preserved``), and an outcome per document.

``rows``: row_id string, doc_id, place array<long>, kind, text, href, parent, plus what the edit names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import ADDRESS, is_blank, linkify
from leafwright.operators.sequence import BLOCK, previous, scan
from leafwright.session import stored


def row_id(doc: Column, place: Column) -> Column:
    """A row's identity: its document and its place when it was made."""
    return F.concat_ws("/", doc.cast("string"), F.array_join(F.transform(place, lambda n: n.cast("string")), "."))


def between(low: Column, high: Column) -> Column:
    """A place after ``low`` and before ``high``, which follow each other; a null ``low`` is the beginning."""
    cut = F.size(low)
    inside = F.slice(high, 1, F.greatest(cut, F.lit(1))) == low  # high lies below low: [3] and [3, 1]
    under = F.concat(low, F.array(F.get(high, cut) - 1))
    first = F.concat(F.slice(high, 1, F.size(high) - 1), F.array(F.element_at(high, -1) - 1, F.lit(0).cast("long")))
    return F.when(low.isNull(), first).when(inside, under).otherwise(F.concat(low, F.array(F.lit(1).cast("long"))))


def _outcomes(docs: DataFrame, touched: DataFrame, kind: str) -> DataFrame:
    """doc_id, kind_id, status, count: applied where a row was allowed to change, else unchanged.

    ``touched``: row_id, doc_id.
    """
    done = touched.groupBy("doc_id").agg(F.count_distinct("row_id").alias("count"))
    n = F.coalesce("count", F.lit(0)).cast("long")
    return docs.select("doc_id").distinct().join(done, "doc_id", "left").select(
        "doc_id", F.lit(kind).alias("kind_id"), F.when(n > 0, "applied").otherwise("unchanged").alias("status"), n.alias("count")
    )


def _marked(rows: DataFrame, enabled: DataFrame) -> DataFrame:
    """Rows with ``__on``: whether their document is among ``enabled``."""
    on = enabled.select("doc_id").distinct().withColumn("__on", F.lit(True))
    return rows.join(on, "doc_id", "left").withColumn("__on", F.coalesce("__on", F.lit(False)))


def linkify_rows(rows: DataFrame, enabled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn the addresses of paragraphs into link rows.

    ``enabled``: doc_id.  A paragraph keeps its row with the text before its first address; the other pieces
    become rows right after it, in order, and joined they give the paragraph's text back.  A paragraph is cut
    in its own row, and only one that can hold an address is searched; its pieces are written once.
    """
    text = F.col("text")
    kept = [c for c in rows.columns if c not in ("text", "href")]
    asked = F.col("__on") & (F.col("kind") == "p") & (text.contains("@") | text.contains("://"))
    # what stands before the first address; a text without one is a single part
    marked = _marked(rows, enabled).withColumn("__parts", F.when(asked, F.split(text, ADDRESS, 2)))
    cut = F.coalesce(F.size("__parts") > 1, F.lit(False))
    pieces = linkify(marked.filter(cut).select(*kept, "text"), "text")
    deeper = F.concat("place", F.array(F.col("segment") + 1))
    inserted = stored(
        pieces.filter((F.col("segment") > 0) | F.col("href").isNotNull()).select(
            row_id(F.col("doc_id"), deeper).alias("row_id"), deeper.alias("place"), F.when(F.col("href").isNotNull(), "link").otherwise("text").alias("kind"),
            F.col("words").alias("text"), "href", F.col("row_id").alias("parent"), *[c for c in kept if c not in ("row_id", "place", "kind", "parent")],
        )
    )
    lead = marked.withColumn("text", F.when(cut, F.get("__parts", F.lit(0))).otherwise(text))
    candidate = lead.select(*rows.columns).unionByName(inserted.select(*rows.columns))
    # every paragraph that was cut has a piece that is a link
    several = inserted.filter("kind = 'link'").select(F.col("parent").alias("row_id"), "doc_id").distinct()
    allowed = several.select("row_id", F.lit("edit").alias("permission")).unionByName(
        inserted.select("row_id", F.lit("create").alias("permission"))
    )
    return candidate, allowed, _outcomes(enabled, several, "text.linkify_addresses")


def drop_spacers(rows: DataFrame, enabled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove empty paragraphs; those with a break or in a protected place stay.

    ``rows`` hold ``breaks`` and ``protected`` (boolean); ``enabled``: doc_id.
    """
    empty = (F.col("kind") == "p") & is_blank(F.col("text")) & ~F.col("breaks") & ~F.col("protected")
    marked = _marked(rows, enabled).withColumn("__gone", F.col("__on") & F.coalesce(empty, F.lit(False)))
    gone = marked.filter("__gone").select("row_id", "doc_id")
    allowed = gone.select("row_id", F.lit("remove").alias("permission"))
    return marked.filter(~F.col("__gone")).select(*rows.columns), allowed, _outcomes(enabled, gone, "text.remove_spacers")


def header_rows(rows: DataFrame, requests: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Group the first rows of a table under a header row that is put before them.

    ``rows`` hold ``y`` (the row's number in its table from 1, null outside) and ``table_id``; ``requests``:
    doc_id, table_id, headers (how many).  A table with no more rows than that is left alone and fails.
    """
    key = ["doc_id", "table_id"]
    sizes = rows.filter("y IS NOT NULL").groupBy(*key).agg(F.max("y").alias("__rows"))
    asked = requests.join(sizes, key, "left").withColumn("__ok", F.coalesce((F.col("headers") < F.col("__rows")) & (F.col("headers") > 0), F.lit(False)))
    good = asked.filter("__ok").select(*key, "headers")
    # the row before each row of the document, wherever it stands
    start = F.element_at("place", 1) - F.pmod(F.element_at("place", 1), F.lit(block))
    lined = scan(rows.select("row_id", "doc_id", "table_id", "y", "place"), ["doc_id"], "place", {"__before": previous(F.col("place"))}, start)
    heads = lined.filter("y = 1").join(good, key).withColumn("__place", between(F.col("__before"), F.col("place")))
    wrappers = stored(
        heads.select(*key, F.col("__place").alias("place"), row_id(F.col("doc_id"), F.col("__place")).alias("row_id"), F.lit("header").alias("kind"))
    )
    over = wrappers.select(*key, F.col("row_id").alias("__parent")).join(good, key)
    joined = rows.join(over, key, "left").withColumn("__moved", F.coalesce(F.col("y") <= F.col("headers"), F.lit(False)))
    parent = F.when(F.col("__moved"), F.col("__parent")).otherwise(F.col("parent"))
    candidate = joined.withColumn("parent", parent).select(*rows.columns).unionByName(wrappers, allowMissingColumns=True)
    moved = rows.select(*key, "row_id", "y").join(over, key).filter(F.col("y") <= F.col("headers"))
    allowed = moved.select("row_id", F.lit("edit").alias("permission")).unionByName(
        wrappers.select("row_id", F.lit("create").alias("permission"))
    )
    status = F.when(F.col("__ok"), "applied").when(F.col("headers") == 0, "unchanged").otherwise("failed")
    outcomes = asked.groupBy("doc_id").agg(F.max(status).alias("status"), F.sum(F.when(F.col("__ok"), F.col("headers")).otherwise(0)).cast("long").alias("count"))
    return candidate, allowed, outcomes.select("doc_id", F.lit("table.headers").alias("kind_id"), "status", "count")
