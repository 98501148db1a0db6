"""Set, multiset, pixel and streaming queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.registry import query
from leafwright.functions.text import has_credentials, visible_words
from leafwright.functions.text import CREDENTIALS
from leafwright.operators import compare
from leafwright.operators.findings import raise_rule
from leafwright.session import table
from leafwright.streaming import incremental

_HALVES = """b AS (SELECT l_suppkey AS doc_id, 'part/' || (l_partkey % 50) AS uri FROM lineitem WHERE l_discount < 0.06),
a AS (SELECT l_suppkey AS doc_id, 'part/' || (l_partkey % 50) AS uri FROM lineitem WHERE l_tax < 0.05)"""


@query(
    "h1_link_difference",
    f"""WITH {_HALVES}, d AS (SELECT doc_id, uri, sum(w) AS w FROM (SELECT *, 1 AS w FROM b UNION ALL SELECT *, -1 FROM a) GROUP BY 1, 2)
        SELECT doc_id, uri, CASE WHEN w > 0 THEN 'FIDELITY004' ELSE 'FIDELITY006' END AS rule_id, abs(w)::BIGINT AS n FROM d WHERE w <> 0""",
)
def h1_link_difference(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    link = [F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("part/"), F.col("l_partkey") % 50).alias("uri")]
    return compare.link_diff(items.filter("l_discount < 0.06").select(*link), items.filter("l_tax < 0.05").select(*link))


@query(
    "h2_violation_regressions",
    """WITH e AS (SELECT user_id AS member, event_type AS message, (json_extract_string(props, '$.k')::BIGINT % 10) AS fingerprint, value FROM events),
       d AS (SELECT member, message, fingerprint, sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) - sum(CASE WHEN value < 60 THEN 1 ELSE 0 END) AS w FROM e GROUP BY 1, 2, 3)
       SELECT member, message, fingerprint, w::BIGINT AS surplus FROM d WHERE w > 0""",
)
def h2_violation_regressions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("member"), F.col("event_type").alias("message"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("fingerprint"), "value",
    )
    keys = ["member", "message", "fingerprint"]
    return compare.regressions(rows.filter("value < 60"), rows.filter("value > 40"), keys)


_PAGES = """b AS (SELECT p_brand || '/' || (p_size % 7) AS doc_id, p_partkey AS page, p_size AS w FROM part WHERE p_partkey % 501 <> 7),
a AS (SELECT p_brand || '/' || (p_size % 7) AS doc_id, p_partkey AS page, CASE WHEN p_partkey % 83 = 0 THEN p_size + 1 ELSE p_size END AS w FROM part WHERE p_partkey % 401 <> 3)"""


@query(
    "h3_page_geometry",
    f"""WITH {_PAGES}, j AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, b.page AS bp, a.page AS ap, b.w IS DISTINCT FROM a.w AS diff
          FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.page = b.page),
        g AS (SELECT doc_id, count(bp) AS source_pages, count(ap) AS candidate_pages, count(*) FILTER (WHERE diff) AS resized FROM j GROUP BY 1)
        SELECT *, CASE WHEN source_pages <> candidate_pages THEN 'FIDELITY001' ELSE 'FIDELITY002' END AS rule_id FROM g WHERE source_pages <> candidate_pages OR resized > 0""",
)
def h3_page_geometry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("/"), F.col("p_size") % 7).alias("doc_id"), k.alias("page"), F.col("p_size").alias("width"), F.lit(842.0).alias("height"), k
    )
    wider = F.when(k % 83 == 0, F.col("width") + 1).otherwise(F.col("width"))
    return compare.geometry_diff(parts.filter(k % 501 != 7), parts.filter(k % 401 != 3).withColumn("width", wider))


@query(
    "h5_opaque_payloads",
    """WITH b AS (SELECT p_type || (p_size % 9) AS doc_id, p_name AS name, sha256(p_brand) AS d FROM part),
       a AS (SELECT p_type || (p_size % 9) AS doc_id, p_name AS name, sha256(CASE WHEN p_partkey % 71 = 0 THEN 'x' ELSE p_brand END) AS d FROM part WHERE p_partkey % 350 <> 1),
       w AS (SELECT doc_id, name, d, sum(w) AS w FROM (SELECT *, 1 AS w FROM b UNION ALL SELECT *, -1 FROM a) GROUP BY 1, 2, 3)
       SELECT doc_id, sum(greatest(w, 0))::BIGINT AS lost, sum(greatest(-w, 0))::BIGINT AS gained FROM w WHERE w <> 0 GROUP BY 1""",
)
def h5_opaque_payloads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        k, F.concat("p_type", F.col("p_size") % 9).alias("doc_id"), F.col("p_name").alias("name"), F.sha2("p_brand", 256).alias("sha256")
    )
    changed = F.when(k % 71 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))
    after = parts.filter(k % 350 != 1).withColumn("sha256", changed)
    return compare.opaque_unchanged(parts, after)


@query(
    "i1_ink_difference",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (floor((x + 1) * 128))::INT) AS luma FROM embeddings),
       p AS (SELECT l.vec_id // 4 AS doc_id, list_zip(l.luma, r.luma) AS z FROM v l JOIN v r ON r.vec_id = l.vec_id + 1),
       t AS (SELECT doc_id, len(list_filter(z, lambda x: (x[1] < 120) <> (x[2] < 120))) AS moved, len(list_filter(z, lambda x: x[1] < 120)) AS l,
         len(list_filter(z, lambda x: x[2] < 120)) AS r FROM p),
       g AS (SELECT doc_id, sum(moved)::BIGINT AS moved, sum(moved) / greatest(sum(l), sum(r), 1) AS ratio FROM t GROUP BY 1)
       SELECT doc_id, moved, round(ratio, 6) AS changed_ratio, CASE WHEN ratio > 0.8 THEN 'FIDELITY005' END AS rule_id FROM g""",
)
def i1_ink_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as tiles of pixels: four neighbours make a page, compared with their successors."""
    luma = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128).cast("int"))
    tiles = table(spark, sf, "embeddings").select("vec_id", luma.alias("luma"))
    right = tiles.select((F.col("vec_id") - 1).alias("vec_id"), F.col("luma").alias("right"))
    pairs = tiles.withColumnRenamed("luma", "left").join(right, "vec_id")
    pages = pairs.select(F.floor(F.col("vec_id") / 4).alias("doc_id"), F.lit(1).alias("page"), "left", "right")
    return compare.ink_diff(pages, 120, 0.8).drop("page")


@query(
    "i2_size_guard",
    """SELECT p_brand AS doc_id, p_partkey AS page, p_size * 400 AS width, p_partkey * 3 AS height FROM part WHERE p_size::BIGINT * 400 * p_partkey * 3 > 20000000""",
)
def i2_size_guard(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("page"), (F.col("p_size") * 400).alias("width"), (F.col("p_partkey") * 3).alias("height")
    )
    return compare.oversize(pages)


@query(
    "j1_audit_stream",
    f"""SELECT doc_id::VARCHAR AS doc_id, 'DATABASE006' AS rule_id FROM documents WHERE regexp_matches(text, '{CREDENTIALS}')
        UNION ALL SELECT doc_id::VARCHAR, 'LANG001' FROM documents WHERE lang = 'es'""",
)
def j1_audit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arriving as a stream, audited batch by batch by the same rules."""

    def audit(batch: DataFrame) -> DataFrame:
        secret = raise_rule(batch.filter(has_credentials(F.col("text"))), "DATABASE006")
        foreign = raise_rule(batch.filter((F.col("lang") == "es") & (visible_words(F.col("text")) != "")), "LANG001")
        return secret.unionByName(foreign)

    stream = incremental.stream_table(spark, sf, "documents")
    known = stream.select(F.col("doc_id").cast("string"), "text", "lang", F.sha2("text", 256).alias("sha256"))
    folder = incremental.audit_stream(known, incremental.run_folder(spark, "audit"), audit)
    return spark.read.parquet(folder).select("doc_id", "rule_id")


@query(
    "j2_progress_fold",
    """WITH e AS (SELECT user_id AS item, event_id % 6 AS step, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'passed' WHEN 'error' THEN 'failed'
         WHEN 'signup' THEN 'skipped' ELSE 'running' END AS state FROM events)
       SELECT item, step, arg_max(state, ts) AS state, count(*) AS n_events FROM e GROUP BY 1, 2""",
)
def j2_progress_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Events as progress observations, folded with state to the latest per item and step."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "passed").when(kind == "error", "failed").when(kind == "signup", "skipped").otherwise("running")
    events = incremental.stream_table(spark, sf, "events").select(
        F.col("user_id").alias("item"), (F.col("event_id") % 6).alias("step"), state.alias("state"), "ts"
    )
    folder = incremental.progress_stream(events, incremental.run_folder(spark, "progress"))
    return incremental.latest_progress(spark, folder)
