"""Line dedup by distinct-site spread.

A line that stands on many different sites is boilerplate.  Each line is named by a 128-bit hash; a
HyperLogLog sketch of the sites per line hash is built in every task and merged by the aggregation, so
a line that stands in a third of all documents travels as one small sketch per task.  Lines whose
estimate is near the threshold get an exact distinct count; those far above it are boilerplate by the
estimate alone.  Of a boilerplate line the first occurrence (smallest key, then position) stays and
every other one is removed.

Only narrow rows (key, position, hash, site) are exchanged for the counts; each text is moved once,
to meet the positions it loses.

Defined results: a null text stays null and has no lines; a null site counts as no site; lines without
a word are never removed; rows that share key and text lose the same positions; an empty table gives
an empty result; other columns pass through, and columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import GAP, read, whole
from leafwright.llm.registry import query
from leafwright.session import stored

MIN_SITES = 10
# The estimate's standard error is 1.04 / sqrt(2^12) = 1.6 per cent, and small counts are almost
# exact; a quarter on either side of the threshold is fifteen errors.
SKETCH_LOG = 12
SLACK = 0.25


def line_rows(docs: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """__key, __text_id, __site, pos, h1, h2: one narrow row per line that has a word."""
    rows = docs.select(
        F.col(key).alias("__key"),
        F.xxhash64(text).alias("__text_id"),
        F.col(site).alias("__site"),
        F.posexplode(F.split(whole(text), "\n")).alias("pos", "line"),
    ).filter(F.col("line").rlike(f"[^{GAP}]"))
    return rows.select(
        "__key", "__text_id", "__site", "pos",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"),
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, slack: float = SLACK) -> DataFrame:
    """h1, h2, first: the lines on at least ``min_sites`` sites and where each stands first."""
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("__site", SKETCH_LOG).alias("sketch"),
        F.min(F.struct("__key", "__text_id", "pos")).alias("first"),
    )
    spread = stored(
        sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(
            F.col("sites") >= min_sites * (1 - slack)
        )
    )
    unsure = F.col("sites") <= min_sites * (1 + slack)
    near = spread.filter(unsure).select("h1", "h2")
    exact = (
        lines.join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count_distinct("__site").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    sure = spread.filter(~unsure).select("h1", "h2", "first")
    confirmed = spread.filter(unsure).join(exact, ["h1", "h2"]).select("h1", "h2", "first")
    return sure.unionByName(confirmed)


def strip_lines(
    docs: DataFrame,
    key: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; adds n_lines and n_removed (long)."""
    lines = stored(line_rows(docs, key, site, text))
    at = F.struct("__key", "__text_id", "pos")
    drops = (
        lines.join(boilerplate(lines, min_sites), ["h1", "h2"])
        .filter(~at.eqNullSafe(F.col("first")))
        .groupBy("__key", "__text_id")
        .agg(F.collect_set("pos").alias("__drop"))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*kept).withColumn("__id", F.xxhash64(text))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__id") == F.col("__text_id"))
    joined = rows.join(drops, same, "left")
    parts = F.split(text, "\n")
    cleaned = F.array_join(
        F.filter(parts, lambda x, i: ~F.array_contains("__drop", i)), "\n"
    )
    n_lines = F.size(F.filter(F.split(whole(text), "\n"), lambda x: x.rlike(f"[^{GAP}]")))
    return joined.select(
        *[
            F.when(F.col("__drop").isNull(), F.col(c)).otherwise(cleaned).alias(c) if c == text else F.col(c)
            for c in kept
        ],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_removed"),
    )


OP10_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^{GAP}]')),
spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM worded GROUP BY line
  HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.*, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone,
    regexp_matches(l.line, '[^{GAP}]') AS worded
  FROM lines l LEFT JOIN spread s USING (line))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY doc_id"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark, sf_dir):
    """Every document without the boilerplate lines of other sites."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return strip_lines(docs).select("doc_id", "text", "n_lines", "n_removed")
