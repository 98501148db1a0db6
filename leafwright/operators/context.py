"""Where in its document something stands: the nearest landmarks before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.sequence import BLOCK, last_known, scan


def with_context(
    questions: DataFrame, landmarks: DataFrame, kinds: list[str], excerpts: DataFrame | None = None, block: Column | int = BLOCK
) -> DataFrame:
    """Each question with the name of the nearest landmark of every kind at or before its place.

    ``questions``: doc_id, pos and anything else.  ``landmarks``: doc_id, pos, kind, name.  ``excerpts``:
    doc_id, pos, excerpt (one row per place), joined where given.  Both sides are laid in one line and a
    running last value is carried from block to block, so no document is a window of its own; questions of
    one place share a row of that line.  A question before all landmarks has null.
    """
    name = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    marks = landmarks.filter(F.col("kind").isin(kinds)).groupBy("doc_id", "pos").agg(
        *[F.max(name(k)).alias(f"__mark_{k}") for k in kinds]
    )
    asked = questions.select("doc_id", "pos").distinct().withColumn("__asked", F.lit(1))
    # the landmarks of a place come before its questions
    line = marks.withColumn("__asked", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    placed = scan(line, ["doc_id"], ["pos", "__asked"], {k: last_known(F.col(f"__mark_{k}")) for k in kinds}, block)
    found = placed.filter("__asked = 1").select("doc_id", "pos", *kinds)
    rows = questions.join(found, ["doc_id", "pos"], "left")
    return rows if excerpts is None else rows.join(excerpts.select("doc_id", "pos", "excerpt"), ["doc_id", "pos"], "left")
