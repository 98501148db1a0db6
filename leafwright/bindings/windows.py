"""Ordered scans over the given tables.

A small block width is used on purpose: the results must not depend on where blocks end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.joins import CONTINUED, RUNS, lists, value_runs
from leafwright.bindings.registry import TAGS, query, words_sql
from leafwright.bindings.scalars import LINES, lines
from leafwright.bindings.sources import page_tags
from leafwright.operators import compare, structure, update
from leafwright.session import table

BLOCK = 500  # far below the default, so that most groups span several blocks


def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings Spark derives from the events; the level comes from the value."""
    level = 1 + F.floor("value") % 11
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), level.alias("level")
    )


HEADINGS = """h AS (SELECT user_id AS doc_id, event_id AS pos, 1 + floor(value)::BIGINT % 11 AS level FROM events),
v AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM h WHERE level <= 10),
checked AS (SELECT doc_id, pos, level, NULL::BIGINT AS prev, 'HEADING001' AS rule_id FROM h WHERE level > 10
  UNION ALL SELECT doc_id, pos, level, prev, CASE WHEN prev IS NULL AND level > 1 THEN 'HEADING002'
    WHEN level > prev + 1 THEN 'HEADING003' END FROM v)"""


@query(
    "f1_heading_hierarchy",
    f"WITH {HEADINGS} SELECT doc_id, pos, level, rule_id FROM checked WHERE rule_id IS NOT NULL",
)
def f1_heading_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    checked = structure.heading_hierarchy(headings(spark, sf), block=BLOCK)
    return checked.filter("rule_id IS NOT NULL").select("doc_id", "pos", "level", "rule_id")


@query(
    "f1_without_headings",
    """SELECT DISTINCT user_id AS doc_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 100)""",
)
def f1_without_headings(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("doc_id", F.col("user_id"))
    docs = events.select("doc_id").distinct()
    return structure.without_headings(docs, events.filter("event_type = 'view' AND value > 100"))


@query(
    "f1_tagged_skips",
    f"""WITH {HEADINGS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM checked WHERE rule_id = 'HEADING003')
        SELECT doc_id, (SELECT count(*) FROM s WHERE s.doc_id = c.doc_id) AS n_skips, max(level) FILTER (WHERE rule_id = 'HEADING002') AS start_level,
          (SELECT string_agg('H' || prev || ' to H' || level, ', ' ORDER BY n) FROM s WHERE s.doc_id = c.doc_id AND n <= 8) AS skips
        FROM checked c GROUP BY doc_id""",
)
def f1_tagged_skips(spark: SparkSession, sf: str) -> DataFrame:
    checked = structure.heading_hierarchy(headings(spark, sf), block=BLOCK)
    return structure.tagged_heading_skips(checked).withColumn("skips", F.array_join("skips", ", "))


@query(
    "f2_context_ordinals",
    f"""WITH {TAGS} SELECT 'page' AS source, page_id AS doc_id, tag AS kind, ord AS pos, row_number() OVER (PARTITION BY page_id, tag ORDER BY ord) AS ordinal
        FROM tags WHERE NOT closing
        UNION ALL SELECT 'talk', conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) FROM conversations""",
)
def f2_context_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    tags = page_tags(spark, sf).filter(~F.col("closing")).select(
        F.lit("page").alias("source"), F.col("page_id").alias("doc_id"), F.col("tag").alias("kind"), F.col("ord").alias("pos")
    )
    turns = table(spark, sf, "conversations").select(
        F.lit("talk").alias("source"), F.col("conv_id").alias("doc_id"), F.col("role").alias("kind"), F.col("turn").alias("pos")
    )
    return structure.context_ordinals(tags.unionByName(turns), ["source", "doc_id", "kind"], "pos", 20)


@query("f3_logical_runs", f"WITH {RUNS} SELECT doc_id, event_id, run_end - repeat + 1 AS run_start, run_end FROM runs")
def f3_logical_runs(spark: SparkSession, sf: str) -> DataFrame:
    return value_runs(spark, sf).select("doc_id", "event_id", "run_start", "run_end")


@query(
    "f4_leading_headers",
    """WITH r AS (SELECT user_id AS doc_id, event_id AS pos, event_type = 'view' OR event_id < 400 AND event_type <> 'error' AS h, floor(value)::BIGINT + 1 AS n FROM events),
       d AS (SELECT doc_id, min(pos) FILTER (WHERE NOT h) AS first FROM r GROUP BY 1)
       SELECT doc_id, coalesce(sum(n) FILTER (WHERE h AND (first IS NULL OR pos < first)), 0)::BIGINT AS leading,
         count(*) FILTER (WHERE h AND pos > first) AS non_leading FROM r JOIN d USING (doc_id) GROUP BY 1""",
)
def f4_leading_headers(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), (F.floor("value") + 1).alias("repeat"),
        ((kind == "view") | ((F.col("event_id") < 400) & (kind != "error"))).alias("header"),
    )
    return structure.leading_headers(rows, ["doc_id"], "pos", F.col("header"), "repeat")


@query("f5_previous_peer", f"WITH {CONTINUED} SELECT doc_id, list_id, peer FROM p")
def f5_previous_peer(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.previous_peer(lists(spark, sf), ["doc_id", "context", "level"], "list_id", "list_id", "style", BLOCK)
    return found.select("doc_id", "list_id", "peer")


@query(
    "f6_trailing_empty",
    """WITH c AS (SELECT conv_id, turn, length(text) < 300 OR conv_id % 10 = 0 AS empty FROM conversations),
       k AS (SELECT conv_id, coalesce(max(turn) FILTER (WHERE NOT empty), min(turn)) AS kept FROM c GROUP BY 1)
       SELECT conv_id, turn FROM c JOIN k USING (conv_id) WHERE empty AND turn > kept""",
)
def f6_trailing_empty(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    empty = (F.length("text") < 300) | (F.col("conv_id") % 10 == 0)
    return structure.trailing_empty(turns, "conv_id", "turn", empty).select("conv_id", "turn")


@query(
    "f7_list_level",
    """SELECT p_partkey, 1 + p_size % 3 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 4 END::BIGINT AS level FROM part""",
)
def f7_list_level(spark: SparkSession, sf: str) -> DataFrame:
    """Counter level from each node's ancestors, reset at the nearest cell."""
    lists_ = lambda n: F.array_repeat(F.lit("list"), n)
    cell = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("table-cell"))).otherwise(F.array().cast("array<string>"))
    ancestors = F.concat(F.array(F.lit("text")), lists_(F.col("p_size") % 4), cell, lists_(F.col("p_size") % 3))
    level = structure.list_level(ancestors, "list", ["table-cell", "text-box"])
    return table(spark, sf, "part").select("p_partkey", level.alias("level"))


def changed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with a word replaced, a tail cut or only page breaks moved."""
    k, pos = F.col("doc_id"), F.col("pos")
    words = F.regexp_replace("text", "the", "then")
    changed = (
        F.when((k % 4 == 1) & (pos % 3 == 0), words)
        .when((k % 4 == 2) & (pos >= 5), "")
        .when((k % 4 == 3) & (pos == 2), F.concat("text", F.lit(" more words")))
        .otherwise(F.col("text"))
    )
    moved = F.when(k % 4 == 0, F.floor((pos + 1) / 2) * 2).otherwise(pos)
    rows = lines(spark, sf).select("doc_id", moved.alias("page"), pos.alias("line"), changed.alias("text"))
    joined = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    return joined.select("doc_id", "page", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("text"))


@query(
    "f8_first_difference",
    f"""WITH {LINES}, ch AS (SELECT doc_id, pos, text, CASE WHEN doc_id % 4 = 1 AND pos % 3 = 0 THEN regexp_replace(text, 'the', 'then', 'g')
            WHEN doc_id % 4 = 2 AND pos >= 5 THEN '' WHEN doc_id % 4 = 3 AND pos = 2 THEN text || ' more words' ELSE text END AS other FROM lines),
        t AS (SELECT doc_id, {words_sql("string_agg(text, ' ' ORDER BY pos)")} AS a, {words_sql("string_agg(other, ' ' ORDER BY pos)")} AS b FROM ch GROUP BY 1),
        c AS (SELECT *, string_split(a, '') AS ca, string_split(b, '') AS cb FROM t WHERE a <> b),
        m AS (SELECT *, list_position(list_transform(list_zip(ca[:least(len(ca), len(cb))], cb[:least(len(ca), len(cb))]), lambda z: z[1] = z[2]), false) AS p FROM c),
        q AS (SELECT doc_id, a, b, coalesce(p - 1, least(length(a), length(b)))::BIGINT AS position FROM m)
        SELECT doc_id, position, substr(a, greatest(position - 40, 0) + 1, position + 40 - greatest(position - 40, 0)) AS source,
          substr(b, greatest(position - 40, 0) + 1, position + 40 - greatest(position - 40, 0)) AS candidate FROM q""",
)
def f8_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    """First difference of every whole document and its changed copy."""
    before = lines(spark, sf).select("doc_id", F.col("pos").alias("page"), "text")
    return compare.first_diff(before, changed_lines(spark, sf), 7)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "f9_plan_order",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, 'content/order[' || o_orderkey || ']') AS place FROM orders""",
)
def f9_plan_order(spark: SparkSession, sf: str) -> DataFrame:
    """Order statuses as three plans of any size, whose paths begin alike."""
    answers = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("plan_id"), F.col("o_orderpriority").alias("kind_id"),
        F.concat(F.lit("content/order["), "o_orderkey", F.lit("]")).alias("path"),
    )
    kinds = update.kind_order(spark, _PRIORITIES[::-1])
    return update.order_plan(answers, kinds, ["plan_id"]).select("o_orderkey", "place")
