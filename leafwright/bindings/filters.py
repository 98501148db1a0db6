"""Single-table checks over the given tables and tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.registry import TAGS, query
from leafwright.bindings.scalars import LINES, NORMAL, lines, pick, pick_sql
from leafwright.bindings.sources import EVENT_RULES_SQL, PACKAGES, event_rules, packages, page_tags
from leafwright.operators import documents
from leafwright.operators.findings import split_blocked
from leafwright.operators.sequence import last_known, running_sum, scan
from leafwright.operators.structure import inside
from leafwright.session import table
from leafwright.sources.corpus import package_members


def text_key(column: str):
    return F.col(column).cast("string")


@query(
    "c1_metadata",
    f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN ' ' ELSE
           regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
           CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'bad_tag_!' WHEN 2 THEN
             upper(regexp_extract(html, '<html lang="([^"]*)"', 1))
           ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS declared FROM pages),
         j AS (SELECT page_id, title, declared, CASE WHEN page_id % 12 = 0 THEN NULL ELSE lang END AS dflt
           FROM p LEFT JOIN documents ON doc_id = page_id),
         t AS (SELECT page_id AS doc_id, declared AS raw FROM j WHERE declared IS NOT NULL), {NORMAL},
         k AS (SELECT j.*, n.tag, n.problem FROM j LEFT JOIN normal n ON n.doc_id = j.page_id)
       SELECT page_id AS doc_id, 'META001' AS rule_id FROM k WHERE trim(title) = ''
       UNION ALL SELECT page_id, 'META004' FROM k WHERE problem IS NOT NULL
       UNION ALL SELECT page_id, 'META002' FROM k WHERE problem IS NULL AND tag IS NULL AND dflt IS NULL
       UNION ALL SELECT page_id, 'META003' FROM k WHERE problem IS NULL AND lower(tag) <> lower(dflt)""",
)
def c1_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Page titles and languages against the language of the document with the same number."""
    key = F.col("page_id")
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    title = F.when(key % 9 == 0, " ").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    declared = (
        F.when(key % 6 == 0, "").when(key % 6 == 1, "bad_tag_!").when(key % 6 == 2, F.upper(lang)).otherwise(lang)
    )
    pages = table(spark, sf, "pages").select(
        key.alias("doc_id"), title.alias("title"), declared.alias("declared")
    )
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    joined = pages.join(docs, "doc_id", "left").withColumn(
        "default_language", F.when(F.col("doc_id") % 12 != 0, F.col("lang"))
    )
    return documents.audit_metadata(joined)


@query(
    "c2_package_shape",
    f"""WITH {PACKAGES}, a AS (SELECT doc_id, count(*) FILTER (WHERE name = 'mimetype') > 0 AS has,
         arg_min(name, ord) AS first, bool_or(name = 'mimetype' AND NOT stored) AS packed,
         bool_or(name = 'mimetype' AND data <> trim(data)) AS unclean,
         bool_or(name = 'content.xml') AS content, bool_or(name = 'styles.xml') AS styles,
         count(*) FILTER (WHERE name = 'meta.xml') > 1 AS doubled, bool_or(name = '../evil') AS unsafe
         FROM members GROUP BY 1)
       SELECT doc_id, 'PKG009' AS rule_id FROM a WHERE doubled
       UNION ALL SELECT doc_id, 'PKG010' FROM a WHERE unsafe
       UNION ALL SELECT doc_id, 'PKG003' FROM a WHERE NOT doubled AND NOT unsafe AND NOT has
       UNION ALL SELECT doc_id, 'PKG004' FROM a WHERE NOT doubled AND NOT unsafe AND has AND unclean
       UNION ALL SELECT doc_id, 'PKG006' FROM a WHERE NOT doubled AND NOT unsafe AND has AND first <> 'mimetype'
       UNION ALL SELECT doc_id, 'PKG007' FROM a WHERE NOT doubled AND NOT unsafe AND has AND packed
       UNION ALL SELECT doc_id, 'PKG008' FROM a WHERE NOT doubled AND NOT unsafe AND NOT content
       UNION ALL SELECT doc_id, 'PKG005' FROM a WHERE NOT doubled AND NOT unsafe AND NOT styles""",
)
def c2_package_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Shape rules over the members read back from real package bytes."""
    return documents.audit_package(package_members(packages(spark, sf)))


_TYPES = [documents.OASIS + k[0] for k in documents.KINDS] + ["text/plain"]
_EXTS = [k[2] for k in documents.KINDS]
_BODIES = [k[3] or "math" for k in documents.KINDS]
_KINDS_SQL = ", ".join(
    f"('{documents.OASIS}{s}', '{e}', {'NULL' if b is None else repr(b)}, {str(d).lower()})"
    for s, _, e, b, d in documents.KINDS
)


@query(
    "c3_document_kind",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'flat' ELSE 'package' END AS layout,
          CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {pick_sql("doc_id", _TYPES)} END AS mt,
          CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'x/y' ELSE {pick_sql("doc_id", _TYPES)} END AS mm,
          CASE WHEN doc_id % 5 = 0 THEN 'office:text' ELSE {pick_sql("doc_id % 19", _BODIES)} END AS body,
          CASE WHEN doc_id % 46 = 0 THEN '.xml' WHEN doc_id % 6 = 0 THEN '.odt' ELSE {pick_sql("doc_id % 19", _EXTS)} END AS ext
          FROM documents),
        k(mt, e, b, dep) AS (VALUES {_KINDS_SQL}), j AS (SELECT d.*, e, b, dep, k.mt IS NOT NULL AS real
          FROM d LEFT JOIN k USING (mt))
        SELECT doc_id, 'PKG002' AS rule_id FROM j WHERE layout = 'flat' AND mt IS NULL
        UNION ALL SELECT doc_id, 'ODF006' FROM j WHERE NOT real
        UNION ALL SELECT doc_id, 'ODF005' FROM j WHERE real AND mm <> mt
        UNION ALL SELECT doc_id, 'ODF007' FROM j WHERE real AND b IS NOT NULL AND b <> body
        UNION ALL SELECT doc_id, 'ODF008' FROM j WHERE real AND NOT CASE WHEN layout = 'flat'
          THEN ext = '.xml' OR ext = '.f' || substr(e, 2) ELSE ext = e END
        UNION ALL SELECT doc_id, 'ODF009' FROM j WHERE real AND dep""",
)
def c3_document_kind(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(key % 23 == 0, "flat").otherwise("package").alias("layout"),
        F.when(key % 29 != 0, pick(key, _TYPES)).alias("media_type"),
        F.when(key % 4 == 0, F.lit(None)).when(key % 10 == 1, "x/y").otherwise(pick(key, _TYPES)).alias(
            "manifest_media_type"
        ),
        F.when(key % 5 == 0, "office:text").otherwise(pick(key % 19, _BODIES)).alias("body"),
        F.when(key % 46 == 0, ".xml").when(key % 6 == 0, ".odt").otherwise(pick(key % 19, _EXTS)).alias("extension"),
    )
    return documents.audit_kind(docs)


@query(
    "c4_blocked_documents",
    f"""WITH f AS (SELECT user_id, CASE WHEN event_type = 'error' AND NOT coalesce(value > 60, false) THEN 'view' ELSE event_type END AS event_type FROM events),
        b AS (SELECT DISTINCT user_id FROM f JOIN {EVENT_RULES_SQL} USING (event_type) WHERE rule_id = 'PKG001')
        SELECT DISTINCT e.user_id::VARCHAR AS doc_id, b.user_id IS NOT NULL AS blocked
        FROM events e LEFT JOIN b USING (user_id)""",
)
def c4_blocked_documents(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("doc_id", text_key("user_id"))
    mild = (F.col("event_type") == "error") & ~F.coalesce(F.col("value") > 60, F.lit(False))
    raised = events.withColumn("event_type", F.when(mild, "view").otherwise(F.col("event_type")))
    findings = raised.join(event_rules(spark), "event_type")
    open_, blocked = split_blocked(findings, events.select("doc_id").distinct())
    return open_.withColumn("blocked", F.lit(False)).unionByName(blocked.withColumn("blocked", F.lit(True)))


def graphics(spark: SparkSession, sf: str) -> DataFrame:
    """Graphics Spark derives from the parts: one brand is a document."""
    k = F.col("p_partkey")
    ancestors = F.when(k % 8 == 0, F.array(F.lit("page"), F.lit("a"))).otherwise(F.array(F.lit("page")))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), k.alias("graphic_id"),
        F.when(k % 7 == 0, "g").otherwise("frame").alias("kind"),
        F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, " ").alias("title"),
        F.when(k % 5 == 0, F.col("p_type")).alias("description"),
        F.when(k % 11 == 0, F.col("p_name")).otherwise("").alias("visible_text"),
        (F.col("p_size") % 2 == 0).alias("payload"), (k % 4 == 0).alias("decorative"),
        ancestors.alias("ancestors"),
    )


GRAPHICS = """g AS (SELECT p_brand AS doc_id, p_partkey AS graphic_id, p_partkey % 7 = 0 AS grp,
  p_partkey % 3 = 0 AS titled, p_partkey % 5 = 0 AS described, p_partkey % 11 = 0 AS worded,
  p_size % 2 = 0 AS payload, p_partkey % 4 = 0 AS decorative, p_partkey % 8 = 0 AS linked FROM part)"""


@query(
    "c5_missing_alternative",
    f"""WITH {GRAPHICS} SELECT doc_id, graphic_id, CASE WHEN payload THEN 'GRAPHIC001' ELSE 'GRAPHIC002' END AS rule_id
        FROM g WHERE NOT titled AND NOT described AND NOT decorative AND (payload OR NOT worded)""",
)
def c5_missing_alternative(spark: SparkSession, sf: str) -> DataFrame:
    return documents.missing_alternative(graphics(spark, sf)).select("doc_id", "graphic_id", "rule_id")


@query(
    "c6_decorative_conflict",
    f"""WITH {GRAPHICS} SELECT doc_id, graphic_id, CASE WHEN grp OR worded OR linked THEN 'GRAPHIC003'
        ELSE 'GRAPHIC004' END AS rule_id FROM g WHERE decorative AND (grp OR worded OR linked OR titled OR described)""",
)
def c6_decorative_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return documents.decorative_conflict(graphics(spark, sf)).select("doc_id", "graphic_id", "rule_id")


@query(
    "c7_link_purpose",
    f"""WITH {TAGS}, s AS (SELECT *, sum(CASE WHEN tag <> 'a' THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER w AS o,
          max(CASE WHEN tag = 'a' AND NOT closing THEN ord END) OVER w AS link FROM tags
          WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
        p AS (SELECT page_id, link, CASE WHEN link % 3 = 0 THEN ' ' ELSE text END AS text,
          link % 9 = 0 AND tag = 'a' AS titled FROM s WHERE o > 0)
        SELECT page_id, link FROM p GROUP BY 1, 2 HAVING NOT bool_or(trim(text) <> '' OR titled)""",
)
def c7_link_purpose(spark: SparkSession, sf: str) -> DataFrame:
    """Links without text or title; a link's pieces are every tag event inside it."""
    tags = page_tags(spark, sf)
    anchor, start = F.col("tag") == "a", ~F.col("closing")
    step = F.when(anchor & start, 1).when(anchor, -1).otherwise(0).cast("long")
    seen = scan(
        tags,
        ["page_id"],
        "ord",
        {"open": running_sum(step), "link": last_known(F.when(anchor & start, F.col("ord")))},
    )
    parts = seen.filter("open > 0").select(
        "page_id",
        "link",
        F.when(F.col("link") % 3 == 0, " ").otherwise(F.col("text")).alias("text"),
        F.when(anchor & (F.col("link") % 9 == 0), "About").alias("title"),
        F.lit(None).cast("string").alias("description"),
    )
    return documents.link_without_purpose(parts, ["page_id", "link"])


@query(
    "c8_eligible_text",
    f"""WITH {TAGS}, s AS (SELECT *, sum(CASE WHEN tag NOT IN ('nav', 'footer', 'script', 'style') THEN 0
           WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY ord) AS o FROM tags)
        SELECT page_id, sum(CASE WHEN o = 0 AND NOT (closing AND tag IN ('nav', 'footer', 'script', 'style'))
          THEN length(text) ELSE 0 END)::BIGINT AS eligible, sum(length(text))::BIGINT AS total FROM s GROUP BY 1""",
)
def c8_eligible_text(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of page text outside navigation, footers, scripts and styles."""
    skipped = F.col("tag").isin("nav", "footer", "script", "style")
    tags = inside(
        page_tags(spark, sf), "page_id", "ord", skipped & ~F.col("closing"), skipped & F.col("closing"), "out"
    )
    size = F.length("text")
    return tags.groupBy("page_id").agg(
        F.sum(F.when(~F.col("out"), size).otherwise(0)).alias("eligible"), F.sum(size).alias("total")
    )


_VIS = {"signup": "section", "click": "hidden-text", "view": "conditional-text", "purchase": "hidden-paragraph"}


def visibility_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Visibility declarations Spark derives from the events."""
    k, kind = F.col("event_id"), F.col("event_type")
    tag = F.coalesce(*[F.when(kind == e, t) for e, t in _VIS.items()], F.lit("p"))
    attrs = F.map_filter(
        F.create_map(
            F.lit("condition"), F.when(k % 3 == 0, "ooow:1").when(k % 3 == 1, " "),
            F.lit("display"), F.when(k % 5 == 0, "none").when(k % 5 == 1, "condition"),
            F.lit("is-hidden"), F.when(k % 7 == 0, "maybe").when(k % 7 == 1, "true"),
            F.lit("string-value"), F.when(k % 2 == 0, "x"),
            F.lit("string-value-if-true"), F.when(k % 4 < 3, "x"),
            F.lit("string-value-if-false"), F.lit("y"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), k.alias("pos"), tag.alias("tag"), attrs.alias("attrs")
    )


@query(
    "c9_visibility",
    """WITH n AS (SELECT user_id, event_id, event_type AS t, event_id % 3 < 2 AS has_c, event_id % 3 = 0 AS cond,
         event_id % 5 = 0 AS d_none, event_id % 5 = 1 AS d_cond, event_id % 7 <> 0 AS bools,
         event_id % 2 = 0 AS sv, event_id % 4 < 3 AS svt FROM events),
       c AS (SELECT *, CASE WHEN t = 'signup' THEN (d_none AND NOT has_c) OR (d_cond AND cond)
           ELSE cond AND bools AND (t <> 'click' OR sv) AND (t <> 'view' OR svt) END AS coherent FROM n
         WHERE t IN ('click', 'view', 'purchase') OR (t = 'signup' AND (has_c OR d_none OR d_cond)))
       SELECT user_id AS doc_id, event_id AS pos, 'ORDER001' AS rule_id, 1::BIGINT AS contexts FROM c WHERE NOT coherent
       UNION ALL SELECT user_id, 0, 'ORDER003', count(*) FROM c GROUP BY 1""",
)
def c9_visibility(spark: SparkSession, sf: str) -> DataFrame:
    contexts = documents.audit_visibility(visibility_nodes(spark, sf))
    one = contexts.filter(~F.col("coherent")).select(
        "doc_id", "pos", F.lit("ORDER001").alias("rule_id"), F.lit(1).cast("long").alias("contexts")
    )
    whole = contexts.groupBy("doc_id").agg(F.count("*").alias("contexts")).select(
        "doc_id", F.lit(0).cast("long").alias("pos"), F.lit("ORDER003").alias("rule_id"), "contexts"
    )
    return one.unionByName(whole)


@query(
    "c10_layout_counts",
    f"""WITH {TAGS} SELECT page_id, tag AS kind, count(*) AS n FROM tags
        WHERE NOT closing AND tag IN ('nav', 'div', 'footer', 'table') GROUP BY 1, 2""",
)
def c10_layout_counts(spark: SparkSession, sf: str) -> DataFrame:
    tags = page_tags(spark, sf).filter(~F.col("closing"))
    tests = {t: F.col("tag") == t for t in ("nav", "div", "footer", "table")}
    return documents.layout_counts(tags, tests, "page_id")


@query(
    "c11_spacers",
    f"""WITH {LINES}, b AS (SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN ' ' ELSE text END AS text,
          pos % 5 = 0 AS protected, CASE WHEN pos % 4 <> 0 THEN 'S' || (pos % 13) END AS style,
          pos % 6 = 0 AS breaks FROM lines),
        e AS (SELECT *, coalesce(style, '(none)') AS s FROM b WHERE trim(text) = '' AND NOT protected),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n FROM (SELECT DISTINCT doc_id, s FROM e))
        SELECT e.doc_id, count(*) AS n, count(*) FILTER (WHERE breaks) AS with_breaks,
          (SELECT string_agg(s, ',' ORDER BY r.n) FROM r WHERE r.doc_id = e.doc_id AND r.n <= 8) AS styles
        FROM e GROUP BY e.doc_id""",
)
def c11_spacers(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("pos")
    blocks = lines(spark, sf).select(
        "doc_id",
        F.when(F.length("text") % 7 == 0, " ").otherwise(F.col("text")).alias("text"),
        (pos % 5 == 0).alias("protected"),
        F.when(pos % 4 != 0, F.concat(F.lit("S"), pos % 13)).alias("style"),
        (pos % 6 == 0).alias("breaks"),
    )
    return documents.spacers(blocks).withColumn("styles", F.array_join("styles", ","))


@query(
    "c12_blinking",
    """SELECT DISTINCT user_id AS doc_id FROM events WHERE value > 200 AND event_type = 'view'""",
)
def c12_blinking(spark: SparkSession, sf: str) -> DataFrame:
    blink = ((F.col("value") > 200) & (F.col("event_type") == "view")).cast("string")
    nodes = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.create_map(F.lit("text-blinking"), blink).alias("attrs")
    )
    return documents.blinking(nodes)


@query(
    "c13_hidden_content",
    """WITH i AS (SELECT c_mktsegment AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'sheet' WHEN 1 THEN 'row' ELSE 'column' END AS class,
           CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS style,
           CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN 'collapse' WHEN c_custkey % 11 = 0 THEN 'filter' ELSE 'visible' END AS state
         FROM customer), s AS (SELECT DISTINCT n_nationkey FROM nation WHERE n_regionkey = 1)
       SELECT doc_id, class, count(*) AS n FROM i LEFT JOIN s ON style = n_nationkey
       WHERE n_nationkey IS NOT NULL OR state IN ('collapse', 'filter') GROUP BY 1, 2""",
)
def c13_hidden_content(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    items = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("doc_id"),
        F.when(k % 3 == 0, "sheet").when(k % 3 == 1, "row").otherwise("column").alias("class"),
        F.when(k % 3 == 0, text_key("c_nationkey")).alias("style"),
        F.when((k % 3 != 0) & (k % 7 == 0), "collapse").when(k % 11 == 0, "filter").otherwise("visible").alias("state"),
    )
    nation = table(spark, sf, "nation").select(
        text_key("n_nationkey").alias("style"), (F.col("n_regionkey") == 1).alias("hidden")
    )
    used = items.filter("style IS NOT NULL").select("doc_id", "style").distinct()
    styles = used.join(nation, "style")
    return documents.hidden_content(items, styles)


@query(
    "c14_math",
    """WITH n AS (SELECT p_brand || '/' || (p_size % 5) AS doc_id, p_partkey % 29 = 0 AS root, CASE p_type WHEN 'STANDARD' THEN 'mi'
           WHEN 'MEDIUM' THEN 'pi' WHEN 'ECONOMY' THEN 'mphantom' WHEN 'LARGE' THEN 'mrow' WHEN 'PROMO' THEN 'mn' ELSE 'annotation' END AS tag,
           p_partkey % 4 = 0 AS words, p_partkey % 58 = 0 AS spoken, p_partkey % 101 = 0 AS ext, p_partkey % 3 = 0 AS hidden FROM part),
       a AS (SELECT doc_id, bool_or(root) AS rooted, bool_or(NOT hidden AND (tag = 'pi' OR (tag IN ('mi', 'mn') AND words))) AS meaning,
         bool_or(spoken) AS spoken, bool_or(ext) AS ext FROM n GROUP BY 1)
       SELECT doc_id, 'MATH001' AS rule_id FROM a WHERE NOT rooted
       UNION ALL SELECT doc_id, 'MATH002' FROM a WHERE rooted AND NOT meaning
       UNION ALL SELECT doc_id, 'MATH003' FROM a WHERE rooted AND NOT spoken
       UNION ALL SELECT doc_id, 'MATH004' FROM a WHERE rooted AND ext""",
)
def c14_math(spark: SparkSession, sf: str) -> DataFrame:
    k, kind = F.col("p_partkey"), F.col("p_type")
    tags = {"STANDARD": "mi", "MEDIUM": "pi", "ECONOMY": "mphantom", "LARGE": "mrow", "PROMO": "mn"}
    nodes = table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("/"), F.col("p_size") % 5).alias("doc_id"),
        (k % 29 == 0).alias("root"),
        F.coalesce(*[F.when(kind == e, t) for e, t in tags.items()], F.lit("annotation")).alias("tag"),
        F.when(k % 4 == 0, F.col("p_name")).alias("text"),
        F.when(k % 58 == 0, F.col("p_name")).alias("alttext"),
        F.when(k % 101 == 0, F.lit("x.png")).alias("reference"),
        F.when(k % 3 == 0, F.array(F.lit("math"), F.lit("mphantom"))).otherwise(F.array(F.lit("math"))).alias("ancestors"),
    )
    return documents.audit_math(nodes)


@query(
    "c15_chart",
    """WITH n AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 9 = 0 THEN 'chart' WHEN o_orderstatus = 'F' THEN 'series'
           WHEN o_orderstatus = 'P' THEN 'title' WHEN o_orderkey % 4 = 0 THEN 'description' ELSE 'label' END AS tag,
           o_orderkey % 2 = 0 AS words, o_orderkey % 27 = 0 AS ext FROM orders),
       a AS (SELECT doc_id, count(*) FILTER (WHERE tag = 'chart') = 1 AS one, bool_or(tag = 'series') AS series,
         bool_or(tag = 'title' AND words) AS titled, bool_or(tag = 'description' AND words) AS described,
         bool_or(tag IN ('title', 'label') AND words) AS labelled, bool_or(tag = 'chart' AND ext) AS ext FROM n GROUP BY 1)
       SELECT doc_id, unnest(list_filter([CASE WHEN NOT one THEN 'CHART001' END, CASE WHEN one AND NOT series THEN 'CHART002' END,
         CASE WHEN one AND NOT titled THEN 'CHART003' END, CASE WHEN one AND NOT described THEN 'CHART004' END,
         CASE WHEN one AND ext THEN 'CHART006' END, CASE WHEN one AND NOT labelled THEN 'CHART008' END],
         lambda x: x IS NOT NULL)) AS rule_id FROM a""",
)
def c15_chart(spark: SparkSession, sf: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tag = (
        F.when(k % 9 == 0, "chart").when(status == "F", "series").when(status == "P", "title")
        .when(k % 4 == 0, "description").otherwise("label")
    )
    nodes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), tag.alias("tag"), F.when(k % 2 == 0, "word").alias("text"),
        F.when(k % 27 == 0, "http://x").when(k % 3 == 0, ".").alias("href"),
    )
    return documents.audit_chart(nodes)


@query(
    "c16_image",
    """WITH f AS (SELECT o_orderkey // 3 AS doc_id, CASE WHEN o_orderkey % 3 = 2 AND o_custkey % 4 = 0 THEN 2 ELSE 1 END AS frame_id,
           CASE WHEN o_custkey % 3 <> 0 THEN 'Pictures/' || (o_custkey % 10) END AS href, o_orderstatus = 'F' AS embedded FROM orders),
       c AS (SELECT doc_id, count(DISTINCT frame_id) AS n, count(href) AS payloads FROM f GROUP BY 1),
       m AS (SELECT DISTINCT l_orderkey // 3 AS doc_id, 'Pictures/' || l_linenumber AS name FROM lineitem)
       SELECT doc_id, 'IMAGE003' AS rule_id, 1::BIGINT AS n_findings FROM c WHERE n <> 1
       UNION ALL SELECT doc_id, 'IMAGE004', 1 FROM c WHERE n = 1 AND payloads = 0
       UNION ALL SELECT f.doc_id, 'IMAGE005', count(*) FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = 1
         LEFT JOIN m ON m.doc_id = f.doc_id AND m.name = f.href WHERE href IS NOT NULL AND NOT embedded AND m.name IS NULL GROUP BY 1""",
)
def c16_image(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    frames = table(spark, sf, "orders").select(
        F.floor(k / 3).alias("doc_id"), F.when((k % 3 == 2) & (c % 4 == 0), 2).otherwise(1).alias("frame_id"),
        F.when(c % 3 != 0, F.concat(F.lit("Pictures/"), c % 10)).alias("href"),
        (F.col("o_orderstatus") == "F").alias("embedded"),
    )
    members = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 3).alias("doc_id"), F.concat(F.lit("Pictures/"), "l_linenumber").alias("name")
    )
    return documents.audit_image(frames, members)


@query(
    "c17_database",
    """WITH n AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 10 < 2 THEN 'database' WHEN o_orderstatus = 'F' THEN 'connection'
          WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'query' ELSE 'component' END
          WHEN o_orderkey % 5 = 2 THEN 'script' ELSE 'login' END AS tag, o_orderkey % 3 AS h, o_orderkey % 4 = 0 AS u FROM orders),
       a AS (SELECT doc_id, count(*) FILTER (WHERE tag = 'database') = 1 AS one, count(*) FILTER (WHERE tag = 'connection') AS conns,
         count(*) FILTER (WHERE tag = 'connection' AND h <> 0) AS ext, count(*) FILTER (WHERE tag = 'connection' AND h = 0) AS int,
         count(*) FILTER (WHERE tag = 'connection' AND h = 1) AS sec, bool_or(tag = 'login' AND u) AS login,
         count(*) FILTER (WHERE tag = 'query') AS q, count(*) FILTER (WHERE tag = 'component') AS comp, bool_or(tag = 'script') AS scr
         FROM n GROUP BY 1),
       m AS (SELECT c_custkey AS doc_id, c_custkey % 3 = 0 AS storage, c_custkey % 7 = 0 AS code FROM customer),
       j AS (SELECT a.*, coalesce(storage, false) AS storage, coalesce(code, false) AS code FROM a LEFT JOIN m USING (doc_id)),
       r AS (SELECT doc_id, unnest(['DATABASE001', 'DATABASE002', 'DATABASE003', 'DATABASE004', 'DATABASE005', 'DATABASE006',
           'DATABASE010', 'DATABASE011', 'DATABASE012']) AS rule_id, unnest([(NOT one)::BIGINT, (one AND conns = 0)::BIGINT,
           CASE WHEN one AND NOT storage THEN int ELSE 0 END, CASE WHEN one THEN ext ELSE 0 END, (one AND login)::BIGINT,
           CASE WHEN one THEN sec ELSE 0 END, (one AND (scr OR code))::BIGINT, CASE WHEN one THEN q ELSE 0 END,
           CASE WHEN one THEN comp ELSE 0 END]) AS n FROM j)
       SELECT * FROM r WHERE n > 0""",
)
def c17_database(spark: SparkSession, sf: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    tag = (
        F.when(k % 10 < 2, "database").when(status == "F", "connection")
        .when(status == "P", F.when(k % 2 == 0, "query").otherwise("component"))
        .when(k % 5 == 2, "script").otherwise("login")
    )
    nodes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), tag.alias("tag"),
        F.when(k % 3 == 0, "sdbc:embedded:h").when(k % 3 == 1, "sdbc:mysql://bob@h/d").otherwise("sdbc:odbc:x").alias("href"),
        F.when(k % 4 == 0, "bob").alias("user"),
    )
    c = F.col("c_custkey")
    names = F.array(
        F.when(c % 3 == 0, "database/data").otherwise("database/"), F.when(c % 7 == 0, "Basic/x").otherwise("meta.xml")
    )
    members = table(spark, sf, "customer").select(c.alias("doc_id"), F.explode(names).alias("name"))
    return documents.audit_database(nodes, members)


@query(
    "c17_authentication_settings",
    """SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderkey % 5 IN (0, 1) AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'O'""",
)
def c17_authentication_settings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    settings = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), pick(k, ["PassWord", "client secret", "a", "b", "c"]).alias("name"),
        F.when(k % 7 == 0, "boolean").alias("kind"), F.when(F.col("o_orderstatus") != "O", "v").otherwise(" ").alias("value"),
    )
    return documents.authentication_settings(settings)


@query(
    "c18_pdf_metadata",
    """WITH d AS (SELECT doc_id, doc_id % 5 = 0 AS t, doc_id % 7 = 0 OR lang = 'es' AS l, doc_id % 3 <> 0 AS m, doc_id % 4 = 0 AS s,
         doc_id % 6 <> 1 AS v, doc_id % 8 < 2 AS u, doc_id % 9 AS pages, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS chars,
         doc_id % 20 = 0 AS g FROM documents)
       SELECT doc_id, unnest(list_filter([CASE WHEN t THEN 'PDF002' END, CASE WHEN l THEN 'PDF003' END, CASE WHEN NOT m THEN 'PDF004' END,
         CASE WHEN s THEN 'PDF005' END, CASE WHEN NOT v THEN 'PDF006' END, CASE WHEN NOT u THEN 'PDF007' END,
         CASE WHEN pages = 0 THEN 'PDF010' END, CASE WHEN pages > 0 AND chars = 0 AND NOT g THEN 'PDF011' END],
         lambda x: x IS NOT NULL)) AS rule_id FROM d""",
)
def c18_pdf_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(k % 5 == 0, " ").otherwise(F.col("source")).alias("title"),
        F.when((k % 7 == 0) | (F.col("lang") == "es"), F.lit(None)).otherwise(F.col("lang")).alias("language"),
        F.when(k % 3 != 0, F.lit(True)).alias("marked"),
        (k % 4 != 0).alias("has_structure"),
        (k % 6 != 1).alias("display_title"),
        F.when(k % 8 == 0, " 1 ").when(k % 8 == 1, "1").when(k % 8 == 2, "2").alias("ua_part"),
        (k % 9).alias("pages"),
        F.when(k % 10 == 0, 0).otherwise(F.col("n_chars")).alias("text_chars"),
        F.when(k % 20 == 0, 1).otherwise(0).alias("described_graphics"),
    )
    return documents.audit_pdf_meta(docs)


@query(
    "c19_protection",
    """WITH m AS (SELECT p_brand || '/' || (p_size % 20) AS doc_id, CASE WHEN p_partkey % 6 = 0 THEN 'META-INF/' || p_partkey || 'signatures.xml'
           WHEN p_partkey % 6 = 1 THEN 'signatures/' || p_name ELSE p_name END AS name, p_partkey % 40 = 0 AS enc FROM part),
       r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS n FROM (SELECT DISTINCT doc_id, name FROM m
         WHERE name LIKE 'META-INF/%'))
       SELECT doc_id, 'PKG011' AS rule_id, string_agg(name, ',' ORDER BY n) AS members FROM r WHERE n <= 8 GROUP BY 1
       UNION ALL SELECT DISTINCT doc_id, 'PKG012', NULL FROM m WHERE enc""",
)
def c19_protection(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("META-INF/"), k, F.lit("signatures.xml")))
        .when(k % 6 == 1, F.concat(F.lit("signatures/"), "p_name")).otherwise(F.col("p_name"))
    )
    members = table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("/"), F.col("p_size") % 20).alias("doc_id"), name.alias("name"),
        (k % 40 == 0).alias("encrypted"),
    )
    return documents.protection(members).withColumn("members", F.array_join("members", ","))


@query(
    "c20_page_names",
    """WITH p AS (SELECT page_id % 40 AS doc_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE
           left(regexp_extract(html, '<title>([^<]*)</title>', 1), 2) END AS name, page_id % 8 = 0 AS blank FROM pages WHERE page_id % 40 <> 7),
       g AS (SELECT doc_id, name, count(*) AS n, count(*) FILTER (WHERE blank) AS u FROM p GROUP BY 1, 2)
       SELECT DISTINCT page_id % 40 AS doc_id, 'PAGE001' AS rule_id, 1::BIGINT AS n FROM pages WHERE page_id % 40 = 7
       UNION ALL SELECT doc_id, 'PAGE002', sum(n)::BIGINT FROM g WHERE name = '' OR n > 1 GROUP BY 1
       UNION ALL SELECT doc_id, 'PAGE003', sum(u)::BIGINT FROM g GROUP BY 1 HAVING sum(u) > 0""",
)
def c20_page_names(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf, "pages").select(
        (k % 40).alias("doc_id"), F.when(k % 10 == 0, "").otherwise(F.left(title, F.lit(2))).alias("name"),
        F.when(k % 8 == 0, " ").otherwise("t").alias("title"),
    )
    docs = pages.select("doc_id").distinct()
    return documents.audit_pages(docs, pages.filter("doc_id <> 7"))


@query(
    "c21_languages",
    f"""WITH {LINES}, b AS (SELECT doc_id, pos, CASE WHEN pos % 6 <> 0 THEN 'S' || (pos % 6) END AS style FROM lines),
        s(style, status, w, a, c) AS (VALUES ('S1', NULL, 'en', NULL, NULL), ('S2', NULL, NULL, NULL, NULL),
          ('S3', 'cyclic', NULL, NULL, NULL), ('S4', NULL, NULL, NULL, 'ar'))
        SELECT doc_id, pos, CASE WHEN b.style IS NOT NULL AND (s.style IS NULL OR status IS NOT NULL) THEN 'LANG002' ELSE 'LANG001' END AS rule_id
        FROM b LEFT JOIN s ON s.style = b.style
        WHERE (b.style IS NOT NULL AND (s.style IS NULL OR status IS NOT NULL)) OR coalesce(w, a, c) IS NULL""",
)
def c21_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose style names no language, or whose style is unresolved or undefined."""
    pos = F.col("pos")
    blocks = lines(spark, sf).select(
        "doc_id", "pos", F.when(pos % 6 != 0, F.concat(F.lit("S"), pos % 6)).alias("style")
    )
    used = blocks.filter("style IN ('S1', 'S2', 'S3', 'S4')").select("doc_id", "style").distinct()
    styles = used.select(
        "doc_id", "style", F.lit(True).alias("known"), F.when(F.col("style") == "S3", "cyclic").alias("status"),
        F.when(F.col("style") == "S1", "en").alias("western"), F.lit(None).cast("string").alias("asian"),
        F.when(F.col("style") == "S4", "ar").alias("complex"),
    )
    return documents.audit_languages(blocks, styles).select("doc_id", "pos", "rule_id")


@query(
    "c22_objects",
    """WITH o AS (SELECT p_type AS doc_id, p_brand || '/' || p_name || '/' || (p_size % 3) AS path, p_partkey % 3 = 0 AS described FROM part),
       g AS (SELECT doc_id, path, count(*) AS n, bool_or(described) AS d FROM o GROUP BY 1, 2)
       SELECT doc_id, path, n, CASE WHEN n > 1 THEN 'DATABASE008' ELSE 'DATABASE009' END AS rule_id FROM g WHERE n > 1 OR NOT d""",
)
def c22_objects(spark: SparkSession, sf: str) -> DataFrame:
    objects = table(spark, sf, "part").select(
        F.col("p_type").alias("doc_id"),
        F.concat_ws("/", "p_brand", "p_name", (F.col("p_size") % 3).cast("string")).alias("path"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(" ").alias("description"),
    )
    return documents.audit_objects(objects).select("doc_id", "path", "n", "rule_id")
