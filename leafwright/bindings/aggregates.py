"""Roll-ups over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.filters import text_key
from leafwright.bindings.joins import RANGES, RUNS, series_ranges, value_runs
from leafwright.bindings.registry import TAGS, query
from leafwright.bindings.scalars import LINES, lines
from leafwright.bindings.sources import FINDINGS, page_findings, page_tags
from leafwright.operators import documents, findings as fo
from leafwright.operators import grids, status, structure
from leafwright.operators.graph import STANDARD_ROLES
from leafwright.operators.sequence import first_list
from leafwright.session import literal_frame, table


@query(
    "e2_gate",
    f"""WITH {FINDINGS}, s AS (SELECT page_id, count(*) FILTER (WHERE severity = 'error') AS e,
         count(*) FILTER (WHERE severity = 'warning') AS w FROM findings GROUP BY 1)
       SELECT page_id::VARCHAR AS doc_id, (page_id % 2 = 0) AS strict,
         CASE WHEN e > 0 THEN 2 WHEN page_id % 2 = 0 AND w > 0 THEN 1 ELSE 0 END::BIGINT AS status FROM s""",
)
def e2_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Gate of every page, even pages under the strict profile."""
    strict = F.col("doc_id").cast("long") % 2 == 0
    counts = fo.summary(page_findings(spark, sf))
    code = fo.gate(F.col("errors"), F.col("warnings"), strict).cast("long")
    return counts.select("doc_id", strict.alias("strict"), code.alias("status"))


ORDER_CODES = """CASE WHEN o_orderkey % 97 = 0 THEN 3 WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' THEN 1
  WHEN o_orderkey % 7 = 0 THEN 4 ELSE 2 END"""


def order_code():
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return (
        F.when(k % 97 == 0, 3).when(s == "O", 0).when(s == "P", 1).when(k % 7 == 0, 4).otherwise(2)
    )


@query(
    "e3_combine_status",
    f"""WITH o AS (SELECT o_custkey, {ORDER_CODES} AS code FROM orders),
        g AS (SELECT o_custkey, arg_max(code, CASE code WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE code END) AS code FROM o GROUP BY 1)
        SELECT c_custkey, coalesce(code, 0)::BIGINT AS status FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
)
def e3_combine_status(spark: SparkSession, sf: str) -> DataFrame:
    """Strongest order status per customer; a customer without orders passes."""
    coded = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), order_code().alias("code"))
    strongest = coded.groupBy("c_custkey").agg(fo.combine_status(F.col("code")).alias("status"))
    joined = table(spark, sf, "customer").select("c_custkey").join(strongest, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("status", F.lit(0)).cast("long").alias("status"))


_QUESTION_KINDS = {"click": ("HEADING001", "heading.level"), "view": ("HEADING003", "heading.level"), "error": ("SHEET001", "sheet.name")}


@query(
    "e4_open_questions",
    """WITH f AS (SELECT user_id::VARCHAR AS doc_id, event_id AS pos, json_extract_string(props, '$.k') AS path,
         CASE event_type WHEN 'click' THEN 'HEADING001' WHEN 'view' THEN 'HEADING003' ELSE 'SHEET001' END AS rule_id,
         CASE WHEN event_type = 'error' THEN 'sheet.name' ELSE 'heading.level' END AS kind_id, (event_id % 40 = 0)::VARCHAR AS fp
         FROM events WHERE event_type IN ('click', 'view', 'error')),
       r AS (SELECT doc_id, kind_id, path, rule_id, min(pos) AS p, count(*) AS n, min(fp) AS lo, max(fp) AS hi FROM f GROUP BY 1, 2, 3, 4)
       SELECT doc_id, kind_id, path, string_agg(rule_id, ',' ORDER BY p, rule_id) AS rules, sum(n)::BIGINT AS n_findings,
         min(lo) <> max(hi) AS conflict, min(lo) AS fingerprint FROM r GROUP BY 1, 2, 3""",
)
def e4_open_questions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        text_key("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.get_json_object("props", "$.k").alias("path"),
        F.coalesce(*[F.when(kind == e, r) for e, (r, _) in _QUESTION_KINDS.items()]).alias("rule_id"),
        F.coalesce(*[F.when(kind == e, k) for e, (_, k) in _QUESTION_KINDS.items()]).alias("kind_id"),
        (F.col("event_id") % 40 == 0).cast("string").alias("fingerprint"),
    )
    return fo.open_questions(rows)


def stage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stage outcomes Spark derives from the events: one user is a run."""
    kind = F.col("event_type")
    code = F.when(kind == "error", F.when(F.col("value") > 80, 3).otherwise(2)).when(
        (kind == "view") & (F.col("value") > 150), 1
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("item"), F.col("event_id").alias("ord"), F.concat_ws("-", "event_type", "event_id").alias("stage"),
        F.coalesce(code, F.lit(0)).alias("status"),
    )


@query(
    "e5_failed_stage",
    """WITH s AS (SELECT user_id AS item, event_id AS ord, event_type || '-' || event_id AS stage, CASE WHEN event_type = 'error' THEN
         CASE WHEN value > 80 THEN 3 ELSE 2 END WHEN event_type = 'view' AND value > 150 THEN 1 ELSE 0 END AS status FROM events)
       SELECT item, arg_min(stage, ord) FILTER (WHERE status <> 0) AS failed_stage,
         arg_max(status, CASE status WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE status END)::BIGINT AS exit_status,
         CASE WHEN count(*) FILTER (WHERE status <> 0) > 0 THEN 'failed' ELSE 'passed' END AS run_status FROM s GROUP BY 1""",
)
def e5_failed_stage(spark: SparkSession, sf: str) -> DataFrame:
    runs = status.failed_stage(stage_rows(spark, sf), ["item"])
    return runs.withColumn("exit_status", F.col("exit_status").cast("long"))


def batch_items(spark: SparkSession, sf: str) -> DataFrame:
    """Batch items Spark derives from customers and their orders; a market segment is a batch."""
    coded = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), order_code().alias("code"))
    codes = coded.groupBy("c_custkey").agg(fo.combine_status(F.col("code")).alias("exit_status"))
    joined = table(spark, sf, "customer").join(codes, "c_custkey", "left")
    k = F.col("c_custkey")
    return joined.select(
        k.alias("item"), F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey") % 5).alias("batch"),
        (F.col("exit_status").isNotNull() | (k % 2 == 0)).alias("started"),
        ((k % 400 == 7) & F.col("exit_status").isNotNull()).alias("interrupted"), "exit_status",
    )


ITEMS = f"""g AS (SELECT o_custkey, arg_max(code, CASE code WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE code END) AS code
  FROM (SELECT o_custkey, {ORDER_CODES} AS code FROM orders) GROUP BY 1),
i AS (SELECT c_custkey AS item, c_mktsegment || '/' || (c_nationkey % 5) AS batch, code IS NOT NULL OR c_custkey % 2 = 0 AS started,
  c_custkey % 400 = 7 AND code IS NOT NULL AS interrupted, code FROM customer LEFT JOIN g ON o_custkey = c_custkey),
items AS (SELECT item, batch, started, interrupted, CASE WHEN interrupted THEN 3 ELSE code END AS exit_status,
  CASE WHEN interrupted THEN 'interrupted' WHEN code IS NOT NULL THEN CASE WHEN code <> 0 THEN 'failed' ELSE 'completed' END
    WHEN started THEN 'running' ELSE 'pending' END AS item_status FROM i)"""


@query("e6_item_status", f"WITH {ITEMS} SELECT item, batch, exit_status::BIGINT AS exit_status, item_status FROM items")
def e6_item_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = status.item_status(batch_items(spark, sf))
    return rows.select("item", "batch", F.col("exit_status").cast("long"), "item_status")


@query(
    "e6_batch_status",
    f"""WITH {ITEMS}, b AS (SELECT batch, count(*) AS n_items, count(*) FILTER (WHERE NOT started) AS n_pending,
          count(*) FILTER (WHERE item_status = 'failed') AS n_failed, bool_or(interrupted) AS int, bool_and(exit_status IS NOT NULL) AS done,
          arg_max(coalesce(exit_status, 0), CASE coalesce(exit_status, 0) WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE coalesce(exit_status, 0) END) AS code FROM items GROUP BY 1)
        SELECT batch, n_items, n_pending, n_failed, CASE WHEN int THEN 3 ELSE code END::BIGINT AS exit_status,
          CASE WHEN int THEN 'interrupted' WHEN done THEN CASE WHEN code <> 0 THEN 'failed' ELSE 'completed' END ELSE 'running' END AS batch_status FROM b""",
)
def e6_batch_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = status.batch_status(batch_items(spark, sf), ["batch"])
    return rows.withColumn("exit_status", F.col("exit_status").cast("long"))


@query(
    "e7_style_usage",
    """WITH b AS (SELECT l_returnflag || l_linestatus || l_linenumber AS style FROM lineitem), u AS (SELECT style, count(*) AS n FROM b GROUP BY 1)
       SELECT style, n, CASE WHEN style LIKE 'R%' THEN NULL ELSE left(style, 1) END AS parent FROM u ORDER BY n DESC, style""",
)
def e7_style_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Use of every style with its parent, most used first."""
    items = table(spark, sf, "lineitem")
    name = F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("style")
    defined = items.filter("l_returnflag <> 'R'").groupBy(name).agg(F.min("l_returnflag").alias("parent"))
    used = documents.style_usage(items.select(name), defined.withColumn("status", F.lit(None).cast("string")), ["style"])
    return used.select("style", "n", "parent").orderBy(F.desc("n"), "style")


@query("e8_tag_histogram", f"WITH {TAGS} SELECT page_id, tag, count(*) AS n FROM tags WHERE NOT closing GROUP BY 1, 2")
def e8_tag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return page_tags(spark, sf).filter(~F.col("closing")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_STANDARD_SQL = ", ".join(f"'{r}'" for r in STANDARD_ROLES)


@query(
    "e8_unmapped_roles",
    f"""WITH {TAGS}, r AS (SELECT DISTINCT page_id, CASE WHEN tag IN ('p', 'h1', 'a') THEN upper(tag) ELSE tag END AS role FROM tags WHERE NOT closing),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY role) AS n FROM r WHERE role NOT IN ({_STANDARD_SQL}))
        SELECT page_id, count(*) AS n_unmapped, string_agg(role, ',' ORDER BY role) FILTER (WHERE n <= 8) AS first_roles FROM n GROUP BY 1""",
)
def e8_unmapped_roles(spark: SparkSession, sf: str) -> DataFrame:
    """PDF012: custom tags without a standard role, with the first eight."""
    tag = F.col("tag")
    role = F.when(tag.isin("p", "h1", "a"), F.upper(tag)).otherwise(tag)
    seen = page_tags(spark, sf).filter(~F.col("closing")).select("page_id", role.alias("role")).distinct()
    custom = seen.filter(~F.col("role").isin(STANDARD_ROLES))
    counted = custom.groupBy("page_id").agg(F.count("*").alias("n_unmapped"))
    listed = first_list(custom, ["page_id"], ["role"], F.col("role"), "first_roles")
    return counted.join(listed.withColumn("first_roles", F.array_join("first_roles", ",")), "page_id")


@query(
    "e9_duplicate_texts",
    """SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def e9_duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies; only digests are shuffled, never the texts."""
    digests = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"))
    return fo.duplicates(digests, ["sha256"])


@query(
    "e9_duplicate_ids",
    """SELECT user_id AS doc_id, json_extract_string(props, '$.k') AS xml_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def e9_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.get_json_object("props", "$.k").alias("xml_id"))
    return fo.duplicates(rows, ["doc_id", "xml_id"])


@query(
    "e10_version_agreement",
    """WITH p AS (SELECT source AS doc_id, CASE WHEN doc_id % 60 = 3 THEN NULL WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS version FROM documents)
       SELECT doc_id, count(DISTINCT version) AS n_versions, count(*) FILTER (WHERE version IS NULL) AS n_missing, count(*) AS n_parts,
         min(version) AS low, max(version) AS high, CASE WHEN count(DISTINCT version) <> 1 OR count(*) <> count(version) THEN 'ODF001' END AS rule_id
       FROM p GROUP BY 1""",
)
def e10_version_agreement(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    version = F.when(k % 60 == 3, F.lit(None)).when(k % 3 == 0, "en").otherwise(F.col("lang"))
    parts = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), version.alias("version"))
    return fo.version_agreement(parts)


@query(
    "e10_manifest_versions",
    """WITH d AS (SELECT doc_id, lang AS v, CASE WHEN doc_id % 4 = 0 THEN 'en' END AS mv, CASE WHEN doc_id % 5 < 3 THEN 'de' END AS ev, doc_id % 7 <> 0 AS root FROM documents)
       SELECT doc_id, 'ODF003' AS rule_id FROM d WHERE mv <> v UNION ALL SELECT doc_id, 'ODF002' FROM d WHERE NOT root
       UNION ALL SELECT doc_id, 'ODF004' FROM d WHERE root AND ev <> v""",
)
def e10_manifest_versions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("version"), F.when(k % 4 == 0, "en").alias("manifest_version"),
        F.when(k % 5 < 3, "de").alias("entry_version"), (k % 7 != 0).alias("has_root_entry"),
    )
    return fo.manifest_versions(docs)


@query(
    "e11_fonts",
    """SELECT p_type AS doc_id, p_name AS font, bool_or(p_partkey % 9 = 0) AS embedded FROM part GROUP BY 1, 2""",
)
def e11_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """Fonts without their subset tag; embedded if any subset is."""
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("ABCDEF+"), "p_name")).otherwise(F.col("p_name"))
    return documents.fonts(table(spark, sf, "part").select(F.col("p_type").alias("doc_id"), raw.alias("font"), (k % 9 == 0).alias("embedded")))


# Review topics in canonical order.
TOPICS = """
alt-text chart-meaning colour colour-and-layout database-meaning export-boundary header-cells headings
hidden-content image-meaning labels-and-ranges language layers-and-annotations layout link-purpose lists
mathematics page-titles privacy-and-execution reading-order sheet-names slides-and-notes
source-assurance source-boundary table-headers
""".split()
_EVENT_TOPICS = {"click": "link-purpose", "view": "headings", "error": "alt-text", "signup": "language", "purchase": "reading-order"}
_TOPIC_SQL = ", ".join(f"('{t}', {i})" for i, t in enumerate(TOPICS))


@query(
    "e12_review_topics",
    f"""WITH t(topic, o) AS (VALUES {_TOPIC_SQL}), s AS (SELECT DISTINCT user_id AS doc_id, CASE event_type WHEN 'click' THEN 'link-purpose'
          WHEN 'view' THEN 'headings' WHEN 'error' THEN 'alt-text' WHEN 'signup' THEN 'language' ELSE 'reading-order' END AS topic
          FROM events)
        SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS place FROM s JOIN t USING (topic)""",
)
def e12_review_topics(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    topic = F.coalesce(*[F.when(kind == e, t) for e, t in _EVENT_TOPICS.items()])
    seen = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), topic.alias("topic"))
    dimension = literal_frame(spark, [(t, i) for i, t in enumerate(TOPICS)], "topic string, topic_order int")
    return fo.review_topics(seen, dimension)


CELLS = """c AS (SELECT l_orderkey AS table_id, l_linenumber AS y, l_suppkey % 3 AS x, l_linenumber <= l_orderkey % 3 OR l_suppkey % 40 = 0 AS h, l_tax > 0.07 AS s,
  CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'float' ELSE 'string' END AS vt FROM lineitem)"""


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Table cells Spark derives from the line items: one order is a table."""
    old = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")
    header = (F.col("l_linenumber") <= F.col("l_orderkey") % 3) | (F.col("l_suppkey") % 40 == 0)
    return table(spark, sf, "lineitem").select(
        F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("y"),
        (F.col("l_suppkey") % 3).alias("x"), header.alias("is_header"), (F.col("l_tax") > 0.07).alias("spans"),
        F.when(old, "float").otherwise("string").alias("value_type"),
    )


@query(
    "e13_classify_tables",
    f"""WITH {CELLS}, a AS (SELECT table_id, bool_or(h) AS hh, bool_or(s) AS cx, bool_or(vt = 'float') AS ty, count(DISTINCT y) AS rows, count(DISTINCT x) AS columns,
          min(y) FILTER (WHERE NOT h) AS fd, max(y) FILTER (WHERE h) AS lh FROM c GROUP BY 1),
        k AS (SELECT *, CASE WHEN hh AND (cx OR NOT coalesce(lh < fd, true)) THEN 'complex-data' WHEN hh OR ty THEN 'data'
          WHEN least(rows, columns) <= 1 THEN 'layout-candidate' ELSE 'ambiguous' END AS kind FROM a)
        SELECT table_id, rows, columns, kind, CASE WHEN kind IN ('layout-candidate', 'ambiguous') THEN 'TABLE001' WHEN NOT hh THEN 'TABLE003' END AS rule_id FROM k""",
)
def e13_classify_tables(spark: SparkSession, sf: str) -> DataFrame:
    return grids.classify_tables(order_cells(spark, sf)).drop("doc_id")


@query(
    "e13_logical_tables",
    """WITH c AS (SELECT l_suppkey AS t, l_orderkey % 20 + 1 AS y, l_orderkey % 20 + 1 + CASE WHEN l_partkey % 3 = 0 THEN 4 ELSE 0 END AS y_end, l_linenumber AS x,
          l_linenumber + l_partkey % 2 AS x_end, l_orderkey % 20 < l_suppkey % 4 AS rh, l_suppkey % 5 = 0 AS hc, l_quantity = 7 AND l_suppkey % 3 = 0 AS tall, l_quantity = 9 AND l_suppkey % 3 = 0 AS wide,
          l_shipdate < TIMESTAMP '1992-06-01' AS typed FROM lineitem),
        n AS (SELECT t, count(DISTINCT r) AS rows FROM (SELECT t, unnest(range(y, y_end + 1)) AS r FROM c) GROUP BY 1),
        m AS (SELECT t, count(DISTINCT r) AS columns FROM (SELECT t, unnest(range(x, x_end + 1)) AS r FROM c) GROUP BY 1),
        s AS (SELECT t, y, bool_or(rh) AS h, lag(bool_or(rh)) OVER (PARTITION BY t ORDER BY y) AS b FROM c GROUP BY 1, 2),
        q AS (SELECT DISTINCT c.t FROM c JOIN s ON s.t = c.t AND s.h <> s.b AND c.tall AND s.y > c.y AND s.y <= c.y_end + 2
              UNION SELECT t FROM c WHERE wide AND hc AND x <= 1 AND x_end + 1 > 1),
        a AS (SELECT t, bool_or(rh OR (hc AND x <= 1)) AS hh, bool_or(tall OR wide) AS cx, bool_or(typed) AS ty,
          min(y) FILTER (WHERE NOT (rh OR (hc AND x <= 1))) AS fd, max(y) FILTER (WHERE rh OR (hc AND x <= 1)) AS lh FROM c GROUP BY 1),
        k AS (SELECT a.*, rows, columns, CASE WHEN hh AND q.t IS NOT NULL THEN 'ambiguous' WHEN hh AND (cx OR NOT coalesce(lh < fd, true)) THEN 'complex-data' WHEN hh OR ty THEN 'data'
          WHEN least(rows, columns) <= 1 THEN 'layout-candidate' ELSE 'ambiguous' END AS kind FROM a JOIN n USING (t) JOIN m USING (t) LEFT JOIN q USING (t))
        SELECT t AS table_id, rows, columns, kind, CASE WHEN kind IN ('layout-candidate', 'ambiguous') THEN 'TABLE001' WHEN NOT hh THEN 'TABLE003' END AS rule_id FROM k""",
)
def e13_logical_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as tables with repeated rows and columns, merged cells and header bands."""
    c = F.col
    flag = lambda test, n: F.when(test, n).otherwise(0)
    third = c("l_suppkey") % 3 == 0
    y = c("l_orderkey") % 20 + 1
    cells = table(spark, sf, "lineitem").select(
        F.lit("d").alias("doc_id"), c("l_suppkey").alias("table_id"), y.alias("y"), (y + flag(c("l_partkey") % 3 == 0, 4)).alias("y_end"),
        c("l_linenumber").cast("long").alias("x"), (c("l_linenumber") + c("l_partkey") % 2).alias("x_end"), (y - 1 < c("l_suppkey") % 4).alias("row_header"),
        flag(c("l_suppkey") % 5 == 0, 1).alias("header_columns"), (flag((c("l_quantity") == 7) & third, 2) + 1).alias("row_span"),
        (flag((c("l_quantity") == 9) & third, 1) + 1).alias("col_span"), F.lit(False).alias("covered"),
        F.when(c("l_shipdate") < F.lit("1992-06-01").cast("timestamp"), "float").otherwise("string").alias("value_type"),
    )
    placed = cells.withColumn("is_header", c("row_header") | (c("x") <= c("header_columns"))).withColumn(
        "spans", (c("row_span") > 1) | (c("col_span") > 1)
    )
    return grids.classify_tables(placed).drop("doc_id")


@query(
    "e14_data_sheets",
    f"""WITH {LINES}, c AS (SELECT doc_id, pos AS row, unnest(string_split(text, '. ')) AS text, pos = 1 AND doc_id % 3 = 0 AS hr, length(text) % 9 = 0 AS mg FROM lines),
        r AS (SELECT doc_id, row, count(*) FILTER (WHERE trim(text) <> '') AS labels, max(length(text)) FILTER (WHERE trim(text) <> '') AS longest,
          bool_or(hr) AS hr, count(*) FILTER (WHERE mg) AS mg FROM c GROUP BY 1, 2),
        a AS (SELECT doc_id, count(*) FILTER (WHERE labels > 0) AS p, arg_min(labels, row) FILTER (WHERE labels > 0) AS fl,
          arg_min(longest, row) FILTER (WHERE labels > 0) AS lg, bool_or(hr) AS hr, sum(mg)::BIGINT AS merged FROM r GROUP BY 1),
        l AS (SELECT * FROM a WHERE p >= 2 AND fl >= 2 AND lg <= 80)
        SELECT doc_id, merged, 'TABLE004' AS rule_id FROM l WHERE NOT hr UNION ALL SELECT doc_id, merged, 'TABLE005' FROM l WHERE merged > 0""",
)
def e14_data_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sheets: a line is a row, its sentences are cells."""
    pos = F.col("pos")
    cells = lines(spark, sf).select(
        "doc_id", F.lit(1).alias("sheet"), pos.alias("row"), F.explode(F.split("text", r"\. ")).alias("text"),
        ((pos == 1) & (F.col("doc_id") % 3 == 0)).alias("header_row"), (F.length("text") % 9 == 0).alias("merged"),
    )
    return grids.data_sheets(cells).drop("sheet")


@query(
    "e15_table_headers",
    """SELECT l_orderkey AS table_id, count(*) FILTER (WHERE l_linestatus = 'O') AS rows FROM lineitem GROUP BY 1
       HAVING count(*) FILTER (WHERE l_linestatus = 'O') >= 2 AND NOT bool_or(l_linestatus = 'F' AND l_quantity > 40)""",
)
def e15_table_headers(spark: SparkSession, sf: str) -> DataFrame:
    open_ = F.col("l_linestatus") == "O"
    nodes = table(spark, sf, "lineitem").select(
        F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("table_id"),
        F.when(open_, "TR").when(F.col("l_quantity") > 40, "TH").otherwise("TD").alias("role"),
    )
    return structure.table_headers(nodes, "table_id", "TR", "TH").select("table_id", "rows")


@query(
    "e16_merge_facts",
    """SELECT user_id AS doc_id, event_type AS producer, f AS field, arg_max(v, event_id) AS value FROM (
         SELECT user_id, event_type, event_id, 'k' AS f, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS v FROM events
         UNION ALL SELECT user_id, event_type, event_id, 'floor', CASE WHEN value > 100 THEN floor(value)::BIGINT::VARCHAR END FROM events)
       WHERE v IS NOT NULL GROUP BY 1, 2, 3""",
)
def e16_merge_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Later measured values win; a null never overwrites one."""
    k = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k"))
    whole = F.when(F.col("value") > 100, F.floor("value").cast("string"))
    pairs = F.array(
        F.struct(F.lit("k").alias("field"), k.alias("value")), F.struct(F.lit("floor").alias("field"), whole.alias("value"))
    )
    facts = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("producer"), F.col("event_id").alias("pos"), F.explode(pairs).alias("f")
    )
    return fo.merge_facts(facts.select("doc_id", "producer", "pos", "f.*"))


@query(
    "e17_series_consistency",
    f"""WITH {RUNS}, {RANGES}, s AS (SELECT *, last_row - first_row + 1 AS rows, 1 + series_id % 2 * (series_id % 3) AS columns,
          CASE WHEN series_id % 5 <> 0 THEN 21 + series_id % 4 * 20 END AS cr, CASE WHEN series_id % 5 <> 0 THEN 1 END AS cc FROM ranges),
        w AS (SELECT series_id, bool_or(event_type NOT IN ('click', 'view') AND event_id % 2 = 0) AS wrong
          FROM ranges JOIN runs USING (doc_id) WHERE run_end - repeat + 1 <= last_row AND run_end >= first_row GROUP BY 1)
        SELECT doc_id, series_id, unnest(list_filter([CASE WHEN least(rows, columns) > 1 THEN 'CHART009' END,
          CASE WHEN least(rows, columns) = 1 AND least(cr, cc) = 1 AND greatest(rows, columns) <> greatest(cr, cc) THEN 'CHART010' END,
          CASE WHEN coalesce(wrong, false) THEN 'CHART011' END], lambda x: x IS NOT NULL)) AS rule_id
        FROM s LEFT JOIN w USING (series_id)""",
)
def e17_series_consistency(spark: SparkSession, sf: str) -> DataFrame:
    ranges = series_ranges(spark, sf)
    k = F.col("series_id")
    kind = F.when(F.col("event_type").isin("click", "view"), "float").otherwise("string")
    odd = grids.nonnumeric(kind, F.lit(False), F.col("event_id") % 2 == 0)
    hits = grids.cells_in_range(ranges, value_runs(spark, sf).withColumn("nonnumeric", odd), ["doc_id"])
    series = ranges.select(
        "doc_id", "series_id", (F.col("last_row") - F.col("first_row") + 1).alias("rows"), (k % 2 * (k % 3) + 1).alias("columns"),
        F.when(k % 5 != 0, k % 4 * 20 + 21).alias("category_rows"), F.when(k % 5 != 0, F.lit(1).cast("long")).alias("category_columns"),
    )
    return grids.series_consistency(series, hits)


@query(
    "e19_target_groups",
    """WITH p AS (SELECT p_brand AS doc_id, p_name AS path, p_partkey, p_partkey || ':' || p_type || '/' || p_size AS bound, p_type || '/' || p_size AS v FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY p_partkey) AS n FROM p)
       SELECT doc_id, path, count(*) AS n_nodes, substr(sha256(sum(('0x' || substr(sha256(bound), 1, 15))::BIGINT)::VARCHAR), 1, 16) AS digest,
         string_agg(v, '|' ORDER BY n) FILTER (WHERE n <= 8) AS "values" FROM r GROUP BY 1, 2""",
)
def e19_target_groups(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("path"), "p_partkey", "p_type", "p_size")
    groups = fo.target_groups(nodes, ["doc_id", "path"], "p_partkey", F.concat_ws("/", "p_type", F.col("p_size").cast("string")))
    return groups.withColumn("values", F.array_join("values", "|"))


@query(
    "e20_measurements",
    f"""WITH {TAGS}, c AS (SELECT page_id, count(*) FILTER (WHERE tag IN ('h1', 'h2', 'h3')) AS headings, count(*) FILTER (WHERE tag = 'img') AS graphics,
          count(*) FILTER (WHERE tag = 'ul') AS lists, count(*) FILTER (WHERE tag = 'a') AS links FROM tags WHERE NOT closing GROUP BY 1),
        d AS (SELECT page_id, coalesce(headings, 0) AS headings, coalesce(graphics, 0) AS graphics, coalesce(lists, 0) AS lists, coalesce(links, 0) AS links
          FROM pages LEFT JOIN c USING (page_id)),
        u AS (SELECT page_id, field, value FROM (UNPIVOT d ON headings, graphics, lists, links INTO NAME field VALUE value))
        SELECT page_id::VARCHAR AS doc_id, field, CASE WHEN page_id % 4 <> 0 THEN value END AS value FROM u""",
)
def e20_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every page; one that was not inspected has null for each field."""
    doc = text_key("page_id").alias("doc_id")
    inspected = table(spark, sf, "pages").select(doc, (F.col("page_id") % 4 != 0).alias("inspected"))
    rows = page_tags(spark, sf).filter(~F.col("closing")).select(doc, "tag")
    tag = F.col("tag")
    return fo.measure(
        inspected,
        rows,
        {
            "headings": F.count_if(tag.isin("h1", "h2", "h3")), "graphics": F.count_if(tag == "img"),
            "lists": F.count_if(tag == "ul"), "links": F.count_if(tag == "a"),
        },
    )
