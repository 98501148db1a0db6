"""Recursive questions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.joins import CONTINUED, lists
from leafwright.bindings.registry import query
from leafwright.operators import graph, structure
from leafwright.session import table


@query(
    "g1_continuation_cycles",
    """WITH RECURSIVE e AS (SELECT c_nationkey AS doc_id, c_custkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer),
       f AS (SELECT e.doc_id, e.node, t.node AS next FROM e JOIN e t ON t.doc_id = e.doc_id AND t.i = (e.i * 7 + 3) % e.size WHERE e.node % 19 <> 0),
       walk AS (SELECT doc_id, node AS start, next AS cur, 1 AS n FROM f UNION ALL
         SELECT w.doc_id, start, f.next, n + 1 FROM walk w JOIN f ON f.doc_id = w.doc_id AND f.node = w.cur WHERE w.cur <> w.start AND n < 400)
       SELECT DISTINCT doc_id, start AS node FROM walk WHERE cur = start""",
)
def g1_continuation_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles among the customers of a nation: each points to the (7i+3)-th, some to none."""
    from leafwright.operators.sequence import ordinal

    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("node"))
    placed = ordinal(rows, ["doc_id"], "node", "place").withColumn("i", F.col("place") - 1)
    sizes = placed.groupBy("doc_id").agg(F.count("*").alias("size"))
    wanted = placed.join(sizes, "doc_id").filter("node % 19 <> 0").withColumn("j", (F.col("i") * 7 + 3) % F.col("size"))
    targets = placed.select("doc_id", F.col("i").alias("j"), F.col("node").alias("next"))
    return graph.cycles(wanted.join(targets, ["doc_id", "j"]))


@query(
    "g1_list_cycles",
    f"""WITH RECURSIVE {CONTINUED}, f AS (SELECT doc_id, list_id, continues FROM edges WHERE continues IS NOT NULL),
        walk AS (SELECT doc_id, list_id AS start, continues AS cur, 1 AS n FROM f UNION ALL
          SELECT w.doc_id, start, f.continues, n + 1 FROM walk w JOIN f ON f.doc_id = w.doc_id AND f.list_id = w.cur WHERE w.cur <> w.start AND n < 200)
        SELECT DISTINCT doc_id, start AS list_id FROM walk WHERE cur = start""",
)
def g1_list_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """LIST005: lists whose continuation edges run in a circle."""
    edges = structure.continuations(lists(spark, sf))
    found = graph.cycles(edges.select("doc_id", F.col("list_id").alias("node"), F.col("continues").alias("next")))
    return found.withColumnRenamed("node", "list_id")


@query(
    "g2_style_inheritance",
    """WITH RECURSIVE s AS (SELECT 'P' || p_partkey AS name, CASE WHEN p_partkey % 211 = 1 THEN 'P' || (p_partkey - 1) WHEN p_partkey % 211 = 0 THEN 'P' || (p_partkey + 1)
           WHEN p_partkey % 301 = 7 THEN 'none' WHEN p_partkey >= 10 THEN 'P' || (p_partkey // 10) END AS parent, p_partkey % 97 = 5 AS cond, p_partkey % 131 = 9 AS twice,
           CASE WHEN p_partkey % 3 = 0 THEN p_name END AS colour, CASE WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR END AS size FROM part),
       walk AS (SELECT name, name AS cur, CASE WHEN twice THEN 'ambiguous' WHEN cond THEN 'conditional' END AS status, parent AS next, colour, size, 0 AS depth FROM s
         UNION ALL SELECT w.name, w.next, CASE WHEN s.name IS NULL THEN 'missing' WHEN s.twice THEN 'ambiguous' WHEN s.cond THEN 'conditional' END,
           s.parent, coalesce(w.colour, s.colour), coalesce(w.size, s.size), depth + 1
         FROM walk w LEFT JOIN s ON s.name = w.next WHERE w.next IS NOT NULL AND w.status IS NULL AND depth < 40),
       top AS (SELECT name, max(depth) AS d FROM walk GROUP BY 1)
       SELECT w.name, CASE WHEN d = 40 THEN 'cyclic' ELSE status END AS status, CASE WHEN d < 40 AND status IS NULL THEN d END AS depth,
         CASE WHEN d < 40 AND status IS NULL THEN colour END AS colour, CASE WHEN d < 40 AND status IS NULL THEN size END AS size
       FROM walk w JOIN top ON top.name = w.name AND top.d = w.depth""",
)
def g2_style_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as styles: the parent of n is n/10; some are missing, doubled, conditional or cyclic."""
    k = F.col("p_partkey")
    p = lambda c: F.concat(F.lit("P"), c.cast("string"))
    parent = (
        F.when(k % 211 == 1, p(k - 1)).when(k % 211 == 0, p(k + 1)).when(k % 301 == 7, "none").when(k >= 10, p(F.floor(k / 10)))
    )
    props = F.map_filter(
        F.create_map(
            F.lit("colour"), F.when(k % 3 == 0, F.col("p_name")), F.lit("size"), F.when(k % 4 == 0, F.col("p_size").cast("string"))
        ),
        lambda _, v: v.isNotNull(),
    )
    styles = table(spark, sf, "part").select(
        k, F.lit("d").alias("doc_id"), p(k).alias("name"), parent.alias("parent"), (k % 97 == 5).alias("conditional"), props.alias("props")
    )
    doubled = styles.unionByName(styles.filter(k % 131 == 9))
    found = graph.resolve_chains(doubled, ["doc_id", "name"], "parent", props="props")
    ok = F.col("status").isNull()
    return found.select(
        "name", "status", F.when(ok, F.col("depth")).alias("depth"),
        F.when(ok, F.col("props")["colour"]).alias("colour"), F.when(ok, F.col("props")["size"]).alias("size"),
    )


@query(
    "g3_role_map",
    """WITH RECURSIVE m AS (SELECT p_brand AS doc_id, 'r' || p_partkey AS role, CASE p_partkey % 5 WHEN 0 THEN 'Figure' WHEN 1 THEN 'r' || (p_partkey - p_partkey % 25)
           WHEN 2 THEN 'r' || p_partkey WHEN 3 THEN 'Span' ELSE 'dead' END AS mapped, p_partkey FROM part),
       walk AS (SELECT doc_id, role, mapped, 1 AS n FROM m UNION ALL
         SELECT w.doc_id, w.role, m.mapped, n + 1 FROM walk w JOIN m ON m.doc_id = w.doc_id AND m.role = w.mapped WHERE w.mapped NOT IN ('Figure', 'Span') AND n < 30)
       SELECT m.doc_id, m.role, min(CASE WHEN w.mapped IN ('Figure', 'Span') THEN w.mapped END) AS standard_role FROM m JOIN walk w USING (doc_id, role) GROUP BY 1, 2""",
)
def g3_role_map(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    r = lambda c: F.concat(F.lit("r"), c.cast("string"))
    mapped = F.when(k % 5 == 0, "Figure").when(k % 5 == 1, r(k - k % 25)).when(k % 5 == 2, r(k)).when(k % 5 == 3, "Span").otherwise("dead")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), r(k).alias("role"), mapped.alias("mapped"))
    return graph.resolve_roles(rows)


@query(
    "g4_described_graphics",
    """SELECT DISTINCT c_nationkey AS doc_id, c_custkey AS node_id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_custkey % 3 <> 0 AND l_quantity > 45""",
)
def g4_described_graphics(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as figures, their orders and lines below them; heavy lines are painted."""
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey"), "c_name")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    heavy = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    painted = heavy.join(orders, "o_orderkey").join(customers, "c_custkey").select(
        "doc_id", F.col("o_orderkey").alias("node_id"),
        F.array(F.col("c_custkey"), F.lit(-1) - F.col("o_orderkey")).alias("ancestors"),
    )
    figures = customers.select(
        "doc_id", F.col("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("alt")
    )
    return graph.described_graphics(figures, painted).select("doc_id", "node_id")


@query(
    "g5_navigation",
    """WITH s AS (SELECT l_suppkey AS doc_id, l_orderkey AS page_id, l_suppkey || '-' || l_orderkey || '-' || CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE l_linenumber END || '-' || l_partkey AS shape FROM lineitem),
       p AS (SELECT DISTINCT doc_id, page_id, page_id % 3 <> 0 AS declared FROM s),
       l AS (SELECT doc_id, page_id, shape, count(*) AS n FROM (SELECT * FROM s WHERE page_id % 3 <> 0
         UNION ALL SELECT doc_id, page_id, 'extra' FROM p WHERE declared AND page_id % 5 = 0) GROUP BY 1, 2, 3),
       o AS (SELECT doc_id, page_id, shape, count(*) AS m FROM s GROUP BY 1, 2, 3), d AS (SELECT doc_id, shape, count(*) AS k FROM s GROUP BY 1, 2),
       w AS (SELECT doc_id, page_id, bool_or(NOT coalesce(n = 1 AND m = 1 AND k = 1, false)) AS wrong, sum(coalesce(m, 0))::BIGINT AS n_shapes
         FROM l FULL JOIN o USING (doc_id, page_id, shape) LEFT JOIN d USING (doc_id, shape) GROUP BY 1, 2)
       SELECT doc_id, page_id, n_shapes, CASE WHEN declared AND wrong THEN 'PAGE004' WHEN NOT declared AND n_shapes > 1 THEN 'PAGE005' END AS rule_id
       FROM p JOIN w USING (doc_id, page_id)""",
)
def g5_navigation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages of a supplier's document and their lines as shapes."""
    number = F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(F.col("l_linenumber"))
    shapes = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page_id"),
        F.concat_ws("-", "l_suppkey", "l_orderkey", number, "l_partkey").alias("shape_id"),
    )
    key = F.col("page_id")
    pages = shapes.select("doc_id", "page_id").distinct().withColumn("declared", key % 3 != 0)
    extra = pages.filter(F.col("declared") & (key % 5 == 0)).select("doc_id", "page_id", F.lit("extra").alias("nav_order"))
    listed = shapes.filter(key % 3 != 0).unionByName(graph.listed_shapes(extra))
    return graph.navigation(pages, listed, shapes)


@query(
    "g6_reachable_objects",
    """WITH RECURSIVE e AS (SELECT p_brand AS doc_id, 'B' AS node, 'P' || p_partkey AS target FROM part WHERE p_size > 47
         UNION SELECT p_brand, 'P' || p_partkey, 'P' || (p_partkey // 2) FROM part UNION SELECT p_brand, 'P' || p_partkey, 'P' || (p_partkey // 3) FROM part),
       r AS (SELECT DISTINCT p_brand AS doc_id, 'B' AS node FROM part UNION SELECT r.doc_id, e.target FROM r JOIN e USING (doc_id, node))
       SELECT doc_id, (count(*) - 1)::BIGINT AS n_reached, count(*) - 1 > 6 AS incomplete FROM r GROUP BY 1""",
)
def g6_reachable_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects a brand's document reaches; a low limit marks an incomplete inspection."""
    k = F.col("p_partkey")
    p = lambda c: F.concat(F.lit("P"), c.cast("string"))
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), k, "p_size")
    first = parts.filter("p_size > 47").select("doc_id", F.lit("B").alias("node"), p(k).alias("target"))
    below = parts.select("doc_id", p(k).alias("node"), F.explode(F.array(p(F.floor(k / 2)), p(F.floor(k / 3)))).alias("target"))
    roots = parts.select("doc_id").distinct().withColumn("node", F.lit("B"))
    return graph.reachable(roots, first.unionByName(below), 6)
