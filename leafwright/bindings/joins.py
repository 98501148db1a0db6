"""Resolution, pairing, reconciliation and binding queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.filters import text_key
from leafwright.bindings.registry import query
from leafwright.bindings.scalars import pick, pick_sql
from leafwright.bindings.sources import FINDINGS, LINKS, TREE, page_findings, page_links, page_tags
from leafwright.functions.identity import fingerprint, target_path
from leafwright.functions.uri import local_resource
from leafwright.operators import compare, grids, references, structure, update
from leafwright.session import table
from leafwright.operators.context import with_context
from leafwright.sources.html import with_tree

_KIND = ["bookmark", "reference-mark", "link"]


@query(
    "d1_resolve_refs",
    f"""WITH r AS (SELECT o_orderkey, o_custkey % 7 AS doc_id, {pick_sql("o_custkey", _KIND)} AS kind,
           'c' || o_custkey || CASE WHEN o_orderkey % 50 = 0 THEN '|x' ELSE '' END AS name FROM orders),
         a AS (SELECT c_custkey % 7 AS doc_id, {pick_sql("c_custkey", _KIND)} AS kind, 'c' || c_custkey AS name,
           c_custkey % 9 <> 0 AS in_flow FROM customer WHERE c_custkey % 11 <> 0
           UNION ALL SELECT c_custkey % 7, {pick_sql("c_custkey", _KIND)}, 'c' || c_custkey, true FROM customer WHERE c_custkey % 13 = 0),
         g AS (SELECT doc_id, kind, name, count(*) FILTER (WHERE in_flow) AS i, count(*) FILTER (WHERE NOT in_flow) AS o FROM a GROUP BY 1, 2, 3)
       SELECT o_orderkey, CASE WHEN coalesce(o, 0) > 0 THEN 'REF004' WHEN i > 1 THEN 'REF002'
         WHEN coalesce(i, 0) = 0 THEN CASE WHEN kind = 'link' AND contains(name, '|') THEN 'REF004' ELSE 'REF001' END END AS rule_id
       FROM r LEFT JOIN g USING (doc_id, kind, name)""",
)
def d1_resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_custkey"), F.col("c_custkey")
    bar = F.when(F.col("o_orderkey") % 50 == 0, "|x").otherwise("")
    refs = table(spark, sf, "orders").select(
        "o_orderkey", (o % 7).alias("doc_id"), pick(o, _KIND).alias("kind"), F.concat(F.lit("c"), o, bar).alias("name")
    )
    customers = table(spark, sf, "customer").select(
        "c_custkey", (c % 7).alias("doc_id"), pick(c, _KIND).alias("kind"), F.concat(F.lit("c"), c).alias("name"),
        F.lit(None).cast("string").alias("note_class"),
    )
    anchors = (
        customers.filter(c % 11 != 0)
        .withColumn("in_flow", c % 9 != 0)
        .unionByName(customers.filter(c % 13 == 0).withColumn("in_flow", F.lit(True)))
    )
    return references.resolve_refs(refs, anchors).select("o_orderkey", "rule_id")


@query(
    "d2_ref_class",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN 'O' ELSE 'F' END AS note_class,
         o_orderstatus AS owner_class FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE l_linenumber % 4 <> 0 AND l_linestatus <> o_orderstatus""",
)
def d2_ref_class(spark: SparkSession, sf: str) -> DataFrame:
    """Line statuses that differ from their order's; a null class matches anything."""
    refs = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 97).alias("doc_id"), text_key("l_orderkey").alias("name"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linestatus")).alias("note_class"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    notes = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 97).alias("doc_id"), text_key("o_orderkey").alias("name"),
        F.col("o_orderstatus").alias("note_class"),
    )
    return references.ref_class(refs, notes).drop("doc_id", "name")


@query(
    "d3_pair_ranges",
    """WITH m AS (SELECT user_id AS doc_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE (json_extract_string(props, '$.k')::BIGINT // 4)::VARCHAR END AS name,
         CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'point' END AS mark, event_id AS pos, event_id % 2 AS ctx
         FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
       a AS (SELECT doc_id, name, count(*) FILTER (WHERE mark <> 'end') AS owners, count(*) FILTER (WHERE mark = 'start') AS starts,
         count(*) FILTER (WHERE mark = 'end') AS ends, min(pos) FILTER (WHERE mark = 'start') AS sp, min(pos) FILTER (WHERE mark = 'end') AS ep,
         arg_min(ctx, pos) FILTER (WHERE mark = 'start') AS sc, arg_min(ctx, pos) FILTER (WHERE mark = 'end') AS ec FROM m GROUP BY 1, 2)
       SELECT doc_id, name, owners, ends, CASE WHEN owners = 0 THEN ends WHEN owners = 1 AND name <> '' AND
         CASE WHEN starts = 1 THEN coalesce(ends = 1 AND ep > sp AND ec = sc, false) ELSE ends = 0 END THEN 0 ELSE owners END AS n_findings FROM a""",
)
def d3_pair_ranges(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id")
    name = F.floor(F.get_json_object("props", "$.k").cast("long") / 4).cast("string")
    markers = table(spark, sf, "events").filter(kind.isin("signup", "purchase", "error")).select(
        F.col("user_id").alias("doc_id"), F.when(k % 17 == 0, "").otherwise(name).alias("name"),
        F.when(kind == "signup", "start").when(kind == "purchase", "end").otherwise("point").alias("mark"),
        k.alias("pos"), (k % 2).alias("context"),
    )
    return references.pair_ranges(markers, ["doc_id", "name"])


def _revisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kind, k = F.col("event_type"), F.col("event_id")
    ident = F.get_json_object("props", "$.k")
    events = table(spark, sf, "events")
    regions = events.filter(kind.isin("view", "click")).select(
        F.col("user_id").alias("doc_id"), F.when(k % 41 == 0, "").otherwise(ident).alias("id"),
        F.when(k % 5 == 0, ident).alias("old_id"),
        F.when(k % 15 == 0, "other").when(k % 2 == 0, ident).alias("xml_id"),
        F.when(kind == "view", "deletion").otherwise("insertion").alias("kind"),
        F.when(k % 23 == 0, 2).otherwise(1).alias("n_kinds"),
    )
    mark = F.when(kind == "error", "change").when(kind == "signup", "change-start").otherwise("change-end")
    marks = events.filter(~kind.isin("view", "click")).select(
        F.col("user_id").alias("doc_id"), F.when(k % 41 == 0, "").otherwise(ident).alias("id"), mark.alias("mark"),
        k.alias("pos"), (k % 2).alias("context"), (k % 6 != 0).alias("eligible"),
    )
    return regions, marks


@query(
    "d4_pair_revisions",
    """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 41 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS id FROM events),
       r AS (SELECT user_id AS doc_id, id, CASE WHEN event_id % 5 = 0 THEN k END AS old_id,
         CASE WHEN event_id % 15 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN k END AS xml_id,
         CASE WHEN event_type = 'view' THEN 'deletion' ELSE 'insertion' END AS kind, CASE WHEN event_id % 23 = 0 THEN 2 ELSE 1 END AS nk
         FROM e WHERE event_type IN ('view', 'click')),
       d AS (SELECT doc_id, id, count(*) AS n, count(*) FILTER (WHERE NOT (id <> '' AND (old_id IS NULL OR xml_id IS NULL OR old_id = xml_id) AND nk = 1)) AS bad,
         min(kind) AS kind, min(nk) AS nk FROM r GROUP BY 1, 2),
       m AS (SELECT user_id AS doc_id, id, count(*) AS m, count(*) FILTER (WHERE event_type = 'error') AS p, count(*) FILTER (WHERE event_type = 'signup') AS s,
         count(*) FILTER (WHERE event_type = 'purchase') AS e, min(event_id) FILTER (WHERE event_type = 'signup') AS sp,
         min(event_id) FILTER (WHERE event_type = 'purchase') AS ep, count(*) FILTER (WHERE event_id % 6 = 0) AS h
         FROM e WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2),
       j AS (SELECT doc_id, id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(bad, 0) AS bad, coalesce(h, 0) AS h,
         coalesce(nk = 1 AND CASE WHEN kind = 'deletion' THEN m = 1 AND p = 1 ELSE m = 2 AND s = 1 AND e = 1 AND sp < ep AND sp % 2 = ep % 2 END, false) AS fits
         FROM d FULL JOIN m USING (doc_id, id))
       SELECT doc_id, id, bad AS revision001, n > 0 AND m > 0 AND (n <> 1 OR NOT fits) AS revision002, m > 0 AND n <> 1 AS revision003,
         n > 0 AND m = 0 AS revision004, n > 0 AND h > 0 AS revision005 FROM j""",
)
def d4_pair_revisions(spark: SparkSession, sf: str) -> DataFrame:
    return references.pair_revisions(*_revisions(spark, sf))


@query(
    "d4_revision_summary",
    """SELECT user_id AS doc_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS regions,
         count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS markers FROM events GROUP BY 1""",
)
def d4_revision_summary(spark: SparkSession, sf: str) -> DataFrame:
    return references.revision_summary(*_revisions(spark, sf))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes Spark derives from the conversations, one per conversation."""
    role, body = F.col("role"), F.trim("text")
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(role == "system").alias("n_citations"),
        F.count_if((role == "assistant") & (F.col("turn") < 3)).alias("n_bodies"),
        F.bool_or((role == "assistant") & (body != "")).alias("body_filled"),
    )
    k = F.col("conv_id")
    return per.withColumn("doc_id", k % 10).withColumn("note_id", F.when(k % 15 != 0, F.floor(k / 20).cast("string"))).withColumn(
        "note_class", F.when(k % 3 == 0, "footnote").when(k % 3 == 1, "endnote")
    )


NOTES = """n AS (SELECT conv_id, conv_id % 10 AS doc_id, CASE WHEN conv_id % 15 <> 0 THEN (conv_id // 20)::VARCHAR END AS note_id,
  CASE conv_id % 3 WHEN 0 THEN 'footnote' WHEN 1 THEN 'endnote' END AS note_class, count(*) FILTER (WHERE role = 'system') AS c,
  count(*) FILTER (WHERE role = 'assistant' AND turn < 3) AS b, bool_or(role = 'assistant' AND trim(text) <> '') AS f
  FROM conversations GROUP BY ALL)"""


@query(
    "d5_notes",
    f"""WITH {NOTES} SELECT doc_id, note_id, count(*) AS n_notes,
         count(*) FILTER (WHERE NOT (note_id IS NOT NULL AND c = 1 AND b = 1 AND f)) AS note003,
         CASE WHEN note_id IS NOT NULL AND count(*) > 1 THEN count(*) ELSE 0 END AS note004 FROM n GROUP BY 1, 2""",
)
def d5_notes(spark: SparkSession, sf: str) -> DataFrame:
    return references.audit_notes(notes(spark, sf))


@query(
    "d5_note_classes",
    f"""WITH {NOTES} SELECT doc_id, coalesce(note_class, 'unknown') AS note_class, count(*) AS n FROM n GROUP BY 1, 2""",
)
def d5_note_classes(spark: SparkSession, sf: str) -> DataFrame:
    return references.note_classes(notes(spark, sf))


@query(
    "d6_link_structure",
    """WITH a AS (SELECT o_orderkey % 97 AS doc_id, o_orderkey AS ref, o_custkey % 50 AS page, o_orderkey % 6 = 0 AS txt FROM orders),
       e AS (SELECT l_orderkey % 97 AS doc_id, l_partkey AS node_id, CASE WHEN l_suppkey % 10 = 0 THEN l_orderkey + 97000000 ELSE l_orderkey END AS ref,
         CASE WHEN l_linenumber > 1 THEN l_linenumber END AS page, l_quantity > 25 AS alt FROM lineitem),
       h AS (SELECT e.*, a.page AS own FROM e LEFT JOIN a USING (doc_id, ref)),
       m AS (SELECT doc_id, ref, bool_or(page IS NOT NULL AND page <> own) AS f, bool_or(alt) AS alt FROM h WHERE own IS NOT NULL GROUP BY 1, 2),
       p AS (SELECT a.doc_id, 'PDF017' AS rule_id, a.ref FROM a LEFT JOIN m USING (doc_id, ref) WHERE f IS NULL
         UNION ALL SELECT a.doc_id, 'PDF019', a.ref FROM a JOIN m USING (doc_id, ref) WHERE f
         UNION ALL SELECT a.doc_id, 'PDF020', a.ref FROM a LEFT JOIN m USING (doc_id, ref) WHERE NOT txt AND NOT coalesce(alt, false)
         UNION ALL SELECT doc_id, 'PDF018', node_id FROM h GROUP BY doc_id, node_id HAVING NOT bool_or(own IS NOT NULL)),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY ref) AS n FROM p)
       SELECT doc_id, rule_id, count(*) AS n, string_agg(ref::VARCHAR, ',' ORDER BY r.n) FILTER (WHERE r.n <= 8) AS first_refs FROM r GROUP BY 1, 2""",
)
def d6_link_structure(spark: SparkSession, sf: str) -> DataFrame:
    o, lk = F.col("o_orderkey"), F.col("l_orderkey")
    annots = table(spark, sf, "orders").select(
        (o % 97).alias("doc_id"), o.alias("annot_ref"), (F.col("o_custkey") % 50).alias("page_ref"),
        F.when(o % 6 == 0, "To the order").otherwise(" ").alias("contents"),
    )
    elements = table(spark, sf, "lineitem").select(
        (lk % 97).alias("doc_id"), F.col("l_partkey").alias("node_id"),
        F.when(F.col("l_suppkey") % 10 == 0, lk + 97_000_000).otherwise(lk).alias("object_ref"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).cast("long").alias("page_ref"),
        F.when(F.col("l_quantity") > 25, "alt").alias("alt"),
    )
    found = references.link_structure(annots, elements)
    return found.withColumn("first_refs", F.array_join(F.transform("first_refs", lambda r: r.cast("string")), ","))


@query(
    "d7_reconcile_content",
    """WITH c AS (SELECT p_partkey % 20 AS doc_id, p_size AS stream_ref, p_partkey AS mcid FROM part WHERE p_partkey % 3 <> 0),
       w AS (SELECT l_partkey % 20 AS doc_id, p_size AS stream_ref, CASE WHEN l_suppkey % 25 = 3 THEN l_partkey ELSE -l_orderkey END AS mcid, count(*) AS n
         FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
       j AS (SELECT doc_id, stream_ref, mcid, c.rowid_ IS NOT NULL AS has, n FROM (SELECT *, 1 AS rowid_ FROM c) c FULL JOIN w USING (doc_id, stream_ref, mcid))
       SELECT doc_id, stream_ref, mcid, coalesce(n, 0) AS n_refs, 'PDF021' AS rule_id FROM j WHERE n IS NULL
       UNION ALL SELECT doc_id, stream_ref, mcid, n, 'PDF022' FROM j WHERE NOT has
       UNION ALL SELECT doc_id, stream_ref, mcid, n, 'PDF023' FROM j WHERE n > 1""",
)
def d7_reconcile_content(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("stream_ref"))
    k = F.col("p_partkey")
    content = parts.filter(k % 3 != 0).select((k % 20).alias("doc_id"), "stream_ref", k.alias("mcid"))
    marked = F.when(F.col("l_suppkey") % 25 == 3, F.col("l_partkey")).otherwise(-F.col("l_orderkey"))
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), marked.alias("mcid"))
    refs = items.join(parts, "p_partkey").select((k % 20).alias("doc_id"), "stream_ref", "mcid")
    return references.reconcile_content(content, refs)


@query(
    "d7_unmarked_text",
    """SELECT p_brand AS doc_id, p_partkey AS page_no, p_size::BIGINT - 40 AS unmarked_text_ops FROM part WHERE p_size > 40""",
)
def d7_unmarked_text(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.greatest(F.col("p_size").cast("long") - 40, F.lit(0))
    streams = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("page_no"), ops.alias("unmarked_text_ops")
    )
    return references.unmarked_text(streams)


_ROLES = {"ul": "L", "li": "LI", "a": "Lbl", "nav": "Table", "article": "TR", "h1": "TH", "p": "TD", "body": "TBody"}
_ROLE_SQL = "CASE {c} " + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in _ROLES.items()) + " ELSE 'Div' END"


@query(
    "d8_child_roles",
    f"""WITH {TREE}, r AS (SELECT page_id, {_ROLE_SQL.format(c="parent_tag")} AS parent_role, {_ROLE_SQL.format(c="tag")} AS role
          FROM tree WHERE parent_tag IS NOT NULL),
        g AS (SELECT page_id, parent_role, role, count(*) AS n FROM r GROUP BY ALL)
        SELECT page_id AS doc_id, parent_role, role, n, CASE WHEN parent_role IN ('L', 'LI') THEN 'PDF014' ELSE 'PDF015' END AS rule_id FROM g
        WHERE parent_role <> 'Div' AND parent_role IN ('L', 'LI', 'Table', 'TR', 'TBody') AND (parent_role, role) NOT IN
          (('L', 'LI'), ('L', 'L'), ('LI', 'Lbl'), ('Table', 'TR'), ('Table', 'TBody'), ('TBody', 'TR'), ('TR', 'TH'), ('TR', 'TD'))""",
)
def d8_child_roles(spark: SparkSession, sf: str) -> DataFrame:
    role = lambda c: F.coalesce(*[F.when(F.col(c) == t, r) for t, r in _ROLES.items()], F.lit("Div"))
    tree = with_tree(page_tags(spark, sf)).filter("parent_tag IS NOT NULL")
    nodes = tree.select(F.col("page_id").alias("doc_id"), role("parent_tag").alias("parent_role"), role("tag").alias("role"))
    return structure.child_roles(nodes)


@query(
    "d9_list_membership",
    f"""WITH {TREE}, c AS (SELECT page_id, parent_ord, count(*) AS n,
          count(*) FILTER (WHERE t NOT IN ('li', 'header')) AS f, count(*) FILTER (WHERE t = 'header') AS h, arg_min(t, ord) AS first
          FROM (SELECT *, CASE WHEN tag = 'li' AND (page_id + ord) % 11 = 0 THEN 'header' WHEN tag = 'li' AND (page_id + ord) % 37 = 0 THEN 'div' ELSE tag END AS t FROM tree)
          WHERE parent_tag = 'ul' GROUP BY 1, 2)
        SELECT t.page_id AS doc_id, t.ord AS node_id, coalesce(n, 0) AS n_children,
          coalesce(f, 0) > 0 OR coalesce(h, 0) > 1 OR coalesce(h = 1 AND first <> 'header', false) AS list002,
          parent_tag = 'ul' AS list003, t.page_id % 13 = 0 AS list004
        FROM tree t LEFT JOIN c ON c.page_id = t.page_id AND c.parent_ord = t.ord WHERE tag = 'ul'""",
)
def d9_list_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of every page; some items are turned into headers or foreign children by rule."""
    at = F.col("page_id") + F.col("ord")
    item = F.col("tag") == "li"
    tree = with_tree(page_tags(spark, sf)).select(
        F.col("page_id").alias("doc_id"), F.col("ord").alias("node_id"), F.col("parent_ord").alias("parent_id"), "parent_tag",
        "ord", F.when(item & (at % 11 == 0), "header").when(item & (at % 37 == 0), "div").otherwise(F.col("tag")).alias("tag"),
        F.when(F.col("page_id") % 13 == 0, "maybe").when(F.col("page_id") % 13 == 1, "true").alias("continue_numbering"),
    )
    return structure.list_membership(tree, "ul", "li", "header")


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists Spark derives from the events; document order is the event number."""
    k = F.col("event_id")
    style = F.get_json_object("props", "$.k").cast("long") % 5
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), k.alias("list_id"), F.col("event_type").alias("context"), (k % 2).alias("level"),
        F.when(style != 4, F.concat(F.lit("L"), style)).alias("style"),
        F.when(k % 3 == 0, F.concat(F.lit("x"), F.floor(k / 6))).alias("xml_id"),
        F.when(k % 4 == 1, F.concat(F.lit("x"), F.floor((k + F.col("user_id")) / 12))).alias("continue_list"),
        F.when(k % 3 == 1, "true").when(k % 3 == 2, "0").alias("continue_numbering"),
    )


LISTS = """l AS (SELECT user_id AS doc_id, event_id AS list_id, event_type AS context, event_id % 2 AS level,
  CASE WHEN json_extract_string(props, '$.k')::BIGINT % 5 <> 4 THEN 'L' || (json_extract_string(props, '$.k')::BIGINT % 5) END AS style,
  CASE WHEN event_id % 3 = 0 THEN 'x' || (event_id // 6) END AS xml_id,
  CASE WHEN event_id % 4 = 1 THEN 'x' || ((event_id + user_id) // 12) END AS continue_list, event_id % 3 = 1 AS cont FROM events)"""
CONTINUED = f"""{LISTS},
t AS (SELECT doc_id, xml_id, count(*) AS n, min(list_id) AS target, min(context) AS tc, min(level) AS tl FROM l WHERE xml_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN style IS NOT NULL THEN lag(list_id) OVER (PARTITION BY doc_id, context, level, style ORDER BY list_id) END AS peer FROM l),
edges AS (SELECT p.doc_id, p.list_id,
  CASE WHEN continue_list IS NOT NULL THEN CASE WHEN n = 1 THEN target END WHEN cont THEN peer END AS continues,
  CASE WHEN continue_list IS NOT NULL THEN CASE WHEN coalesce(n, 0) <> 1 THEN 'LIST006' WHEN tc <> context OR tl <> level THEN 'LIST007' END
    WHEN cont AND peer IS NULL THEN 'LIST008' END AS rule_id
  FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.xml_id = p.continue_list)"""


@query("d10_continuations", f"WITH {CONTINUED} SELECT * FROM edges")
def d10_continuations(spark: SparkSession, sf: str) -> DataFrame:
    return structure.continuations(lists(spark, sf))


_HREF = ["./{h}", "{h}", "a/../{h}", "../{h}", "{h}?q", "folder/{h}/", "%7E{h}", "/{h}"]


@query(
    "d11_missing_resources",
    f"""WITH {LINKS}, h AS (SELECT page_id % 50 AS doc_id, ord % 8 AS form, substr(href, 2) AS h, page_id + ord AS k, replace({pick_sql("ord", _HREF)}, '{{h}}', substr(href, 2)) AS href FROM links),
         m AS (SELECT DISTINCT page_id % 50 AS doc_id, CASE ord % 4 WHEN 1 THEN substr(href, 2) WHEN 3 THEN 'folder/' || substr(href, 2) || '/content.xml' ELSE '~' || substr(href, 2) END AS name FROM links),
         r AS (SELECT *, CASE form WHEN 0 THEN h WHEN 1 THEN h WHEN 2 THEN h WHEN 5 THEN 'folder/' || h WHEN 6 THEN '~' || h END AS member FROM h)
       SELECT doc_id, href, count(*) AS n FROM r WHERE member IS NULL OR NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = r.doc_id
         AND (m.name = member OR (form = 5 AND m.name = member || '/content.xml'))) GROUP BY 1, 2""",
)
def d11_missing_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Package-local references against members derived from the other links of the page group."""
    links = page_links(spark, sf)
    bare = F.substr("href", F.lit(2))
    doc = (F.col("page_id") % 50).alias("doc_id")
    hrefs = links.select(
        doc, F.replace(pick(F.col("ord"), _HREF), F.lit("{h}"), bare).alias("href"), (F.col("ord") % 8 == 5).alias("folder")
    )
    hrefs = hrefs.withColumn("member", local_resource(F.col("href")))
    turn = F.col("ord") % 4
    name = F.when(turn == 1, bare).when(turn == 3, F.concat(F.lit("folder/"), bare, F.lit("/content.xml"))).otherwise(
        F.concat(F.lit("~"), bare)
    )
    members = links.select(doc, name.alias("name"))
    return references.missing_resources(hrefs, members).groupBy("doc_id", "href").agg(F.count("*").alias("n"))


@query(
    "d12_figures",
    """WITH f AS (SELECT p_brand AS doc_id, p_partkey AS node_id, p_size % 5 = 0 OR p_size % 7 = 0 AS miss FROM part WHERE p_type = 'STANDARD'),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS n, row_number() OVER (PARTITION BY doc_id, miss ORDER BY node_id) AS m FROM f)
       SELECT doc_id, count(*) AS n_figures, count(*) FILTER (WHERE miss) AS n_missing, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) FILTER (WHERE n <= 8) AS first_figures,
         string_agg(node_id::VARCHAR, ',' ORDER BY node_id) FILTER (WHERE miss AND m <= 8) AS first_missing FROM r GROUP BY 1 HAVING bool_or(miss)""",
)
def d12_figures(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    nodes = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("node_id"),
        F.when(F.col("p_type") == "STANDARD", "Figure").otherwise("P").alias("role"),
        F.when(size % 5 == 0, " ").when(size % 7 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("alt"),
    )
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    found = references.figures(nodes)
    return found.withColumn("first_figures", join("first_figures")).withColumn("first_missing", join("first_missing"))


@query(
    "d13_grid_coverage",
    """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 0 THEN 400000 ELSE 8 END AS rows, 6 AS cols FROM orders),
       c AS (SELECT l_orderkey AS id, l_linenumber - 1 AS y, l_suppkey % 6 AS x, CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS rs,
         CASE WHEN l_discount > 0.08 THEN 3 WHEN l_discount > 0.05 THEN 2 ELSE 1 END AS cs, l_tax > 0.07 AS cov FROM lineitem),
       f AS (SELECT id, rows, cols, bool_or(cov OR rs > 1 OR cs > 1) AS complex, bool_or(NOT cov AND (y + rs > rows OR x + cs > cols)) AS beyond,
         sum(CASE WHEN cov THEN 0 ELSE rs * cs END) AS area FROM c JOIN t USING (id) GROUP BY ALL),
       g AS (SELECT *, area > rows * cols AS crowded FROM f WHERE complex),
       s AS (SELECT id FROM g WHERE NOT beyond AND NOT crowded),
       o AS (SELECT id, y + dy AS y, x + dx AS x FROM c JOIN s USING (id), range(0, 2) a(dy), range(0, 3) b(dx) WHERE NOT cov AND dy < rs AND dx < cs),
       k AS (SELECT id, y, x, count(*) AS n FROM o GROUP BY 1, 2, 3),
       ov AS (SELECT DISTINCT id FROM k WHERE n > 1),
       orp AS (SELECT DISTINCT c.id FROM c JOIN s USING (id) LEFT JOIN k ON k.id = c.id AND k.y = c.y AND k.x = c.x WHERE cov AND k.id IS NULL)
       SELECT id AS table_id, 'beyond grid' AS reason FROM g WHERE beyond
       UNION ALL SELECT id, 'overlap' FROM g WHERE NOT beyond AND (crowded OR id IN (SELECT id FROM ov))
       UNION ALL SELECT id, 'covered without origin' FROM g WHERE id IN (SELECT id FROM orp)""",
)
def d13_grid_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as merged cells: one order is a table."""
    k = F.col("o_orderkey")
    tables = table(spark, sf, "orders").select(
        F.lit("d").alias("doc_id"), k.alias("table_id"), F.when(k % 100 == 0, 400_000).otherwise(8).alias("rows"), F.lit(6).alias("columns")
    )
    cells = table(spark, sf, "lineitem").select(
        F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("y"),
        (F.col("l_suppkey") % 6).cast("int").alias("x"), F.when(F.col("l_quantity") > 40, 2).otherwise(1).alias("row_span"),
        F.when(F.col("l_discount") > 0.08, 3).when(F.col("l_discount") > 0.05, 2).otherwise(1).alias("col_span"),
        (F.col("l_tax") > 0.07).alias("covered"),
    )
    return grids.grid_coverage(tables, cells).select("table_id", "reason")


def value_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Cell runs Spark derives from the events: repeat counts become row positions."""
    decl = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", (F.floor("value").cast("long") + 1).alias("repeat"), "event_type"
    )
    return structure.logical_runs(decl, ["doc_id"], "event_id", "repeat")


RUNS = """runs AS (SELECT user_id AS doc_id, event_id, floor(value)::BIGINT + 1 AS repeat, event_type,
  (sum(floor(value)::BIGINT + 1) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS run_end FROM events)"""
RANGES = """ranges AS (SELECT c_custkey AS series_id, c_custkey % 150 AS doc_id, 1 + c_custkey % 700 AS first_row,
  1 + c_custkey % 700 + c_nationkey * 20 AS last_row FROM customer)"""


def series_ranges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    start = k % 700 + 1
    return table(spark, sf, "customer").select(
        k.alias("series_id"), (k % 150).alias("doc_id"), start.alias("first_row"),
        (start + F.col("c_nationkey").cast("long") * 20).alias("last_row"),
    )


@query(
    "d14_cells_in_range",
    f"""WITH {RUNS}, {RANGES} SELECT series_id, count(*) AS n_runs, count(*) FILTER (WHERE event_type = 'error') AS n_errors
        FROM ranges JOIN runs USING (doc_id) WHERE run_end - repeat + 1 <= last_row AND run_end >= first_row GROUP BY 1""",
)
def d14_cells_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """Runs per range; a small bucket shows that a pair spanning buckets is counted once."""
    hits = grids.cells_in_range(series_ranges(spark, sf), value_runs(spark, sf), ["doc_id"], 256)
    return hits.groupBy("series_id").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("event_type") == "error").alias("n_errors")
    )


_PLAN_KINDS = ["heading.level", "page.metadata", "no.kind", "link.description"]


def customer_targets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").filter(k % 31 != 0).select(
        F.col("c_mktsegment").alias("doc_id"), "c_custkey",
        target_path(F.lit("content"), F.lit("customer"), F.when(k % 37 == 0, "twin").otherwise(F.col("c_name")), k).alias("path"),
        fingerprint(["c_custkey", "c_name", "c_nationkey"]).alias("fingerprint"),
    )


def plan_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers Spark derives from the customers, some stale, unknown, doubled or unbound."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey", (k % 300).alias("plan_id"), F.col("c_mktsegment").alias("doc_id"),
        F.sha2(F.when(k % 101 == 0, "old").otherwise(F.col("c_mktsegment")), 256).alias("source_sha256"),
        pick(F.floor(k / 40), _PLAN_KINDS).alias("kind_id"),
        target_path(F.lit("content"), F.lit("customer"), F.when(k % 37 == 0, "twin").otherwise(F.col("c_name")), k).alias("path"),
        F.when(k % 17 == 0, "0000000000000000").otherwise(fingerprint(["c_custkey", "c_name", "c_nationkey"])).alias("fingerprint"),
    )
    return rows.unionByName(rows.filter(k % 53 == 0))


_FP = "substr(sha256(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})), 1, 16)"
_PATH = "'content/customer[name=' || CASE WHEN c_custkey % 37 = 0 THEN 'twin' ELSE url_encode(c_name) END || ']'"
ANSWERS = f"""c AS (SELECT *, {_FP} AS fp, {_PATH} AS path FROM customer),
one AS (SELECT c_custkey, c_custkey % 300 AS plan_id, c_mktsegment AS doc_id, sha256(CASE WHEN c_custkey % 101 = 0 THEN 'old' ELSE c_mktsegment END) AS sha,
  {pick_sql("c_custkey // 40", _PLAN_KINDS)} AS kind_id, path, CASE WHEN c_custkey % 17 = 0 THEN '0000000000000000' ELSE fp END AS fp FROM c),
answers AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE c_custkey % 53 = 0),
live AS (SELECT c_mktsegment AS doc_id, path, count(*) AS n, min(fp) AS fp FROM c WHERE c_custkey % 31 <> 0 GROUP BY 1, 2)"""


@query(
    "d15_bind_answers",
    f"""WITH {ANSWERS}, asked AS (SELECT plan_id, kind_id, path, count(*) AS asked FROM answers GROUP BY 1, 2, 3),
        j AS (SELECT a.plan_id, a.c_custkey, CASE WHEN sha <> sha256(a.doc_id) THEN 'source digest' WHEN a.kind_id = 'no.kind' THEN 'unknown kind'
          WHEN asked > 1 THEN 'answered twice' WHEN n IS NULL THEN 'unknown path' WHEN n > 1 THEN 'ambiguous path' WHEN l.fp <> a.fp THEN 'fingerprint' END AS reason
          FROM answers a JOIN asked USING (plan_id, kind_id, path) LEFT JOIN live l ON l.doc_id = a.doc_id AND l.path = a.path)
        SELECT plan_id, c_custkey, reason, NOT bool_or(reason IS NOT NULL) OVER (PARTITION BY plan_id) AS plan_ok FROM j""",
)
def d15_bind_answers(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("doc_id")).distinct()
    sources = segments.withColumn("sha256", F.sha2("doc_id", 256))
    bound = update.bind_answers(plan_answers(spark, sf), customer_targets(spark, sf).drop("c_custkey"), sources)
    return bound.select("plan_id", "c_custkey", "reason", "plan_ok")


@query(
    "d16_carry_over",
    f"""WITH {ANSWERS}, av AS (SELECT doc_id, path, min(fp) AS fp FROM (SELECT c_mktsegment AS doc_id, path, fp FROM c WHERE c_custkey % 31 <> 0 AND c_custkey % 37 <> 0) GROUP BY 1, 2)
        SELECT o.c_custkey, CASE WHEN av.fp IS NULL THEN 'unavailable' WHEN av.fp <> o.fp THEN 'changed' END AS reason
        FROM one o LEFT JOIN av USING (doc_id, path)""",
)
def d16_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    old = plan_answers(spark, sf).dropDuplicates(["c_custkey"])
    available = customer_targets(spark, sf).filter(k % 37 != 0).drop("c_custkey")
    return update.carry(old, available, ["doc_id", "path"]).select("c_custkey", "reason")


@query(
    "d17_predict",
    """WITH a AS (SELECT DISTINCT user_id::VARCHAR AS doc_id, CASE WHEN user_id % 2 = 0 THEN 'heading.level' ELSE 'sheet.name' END AS kind_id,
         json_extract_string(props, '$.k') AS path FROM events),
       r(kind_id, rule_id) AS (VALUES ('heading.level', 'HEADING001'), ('heading.level', 'HEADING002'), ('heading.level', 'HEADING003'),
         ('sheet.name', 'SHEET001'), ('sheet.name', 'SHEET002')),
       f AS (SELECT user_id::VARCHAR AS doc_id, CASE event_type WHEN 'click' THEN 'HEADING001' WHEN 'view' THEN 'HEADING003' WHEN 'error' THEN 'SHEET001' ELSE 'META001' END AS rule_id,
         json_extract_string(props, '$.k') AS path, value FROM events),
       b AS (SELECT doc_id, rule_id, path, count(*) AS n FROM f GROUP BY ALL), z AS (SELECT doc_id, rule_id, path, count(*) AS n FROM f WHERE value > 30 GROUP BY ALL)
       SELECT a.doc_id, kind_id, a.path, sum(CASE WHEN z.n IS NULL THEN coalesce(b.n, 0) ELSE 0 END)::BIGINT AS resolved, sum(coalesce(z.n, 0))::BIGINT AS remaining
       FROM a JOIN r USING (kind_id) LEFT JOIN b ON b.doc_id = a.doc_id AND b.rule_id = r.rule_id AND b.path = a.path
       LEFT JOIN z ON z.doc_id = a.doc_id AND z.rule_id = r.rule_id AND z.path = a.path GROUP BY 1, 2, 3""",
)
def d17_predict(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rule = F.when(kind == "click", "HEADING001").when(kind == "view", "HEADING003").when(kind == "error", "SHEET001").otherwise("META001")
    events = table(spark, sf, "events").select(
        "event_id", text_key("user_id").alias("doc_id"), rule.alias("rule_id"), F.get_json_object("props", "$.k").alias("path"),
        "value", F.when(F.col("user_id") % 2 == 0, "heading.level").otherwise("sheet.name").alias("kind_id"),
    )
    answers = events.select("doc_id", "kind_id", "path").distinct()
    return update.predict(answers, events, events.filter("value > 30"))


_NAMES = ["{n}", "d/{n}.bin", "../{n}", "con/{n}"]


@query(
    "d18_verify_manifest",
    f"""WITH p AS (SELECT p_partkey, p_brand AS bundle_id, replace({pick_sql("p_size", _NAMES)}, '{{n}}', p_partkey::VARCHAR) AS name FROM part),
        r AS (SELECT bundle_id, name, sha256(name) AS d, p_partkey % 19 = 0 AS twice FROM p WHERE p_partkey % 7 <> 0),
        o AS (SELECT bundle_id, name, sha256(CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE name END) AS d, p_partkey % 23 = 0 AS link FROM p WHERE p_partkey % 5 <> 0)
        SELECT * FROM (SELECT coalesce(r.bundle_id, o.bundle_id) AS bundle_id, coalesce(r.name, o.name) AS name,
          CASE WHEN coalesce(r.name, o.name) LIKE '../%' OR coalesce(r.name, o.name) LIKE 'con/%' OR link THEN 'Unsafe' WHEN twice THEN 'Repeated'
            WHEN o.name IS NULL THEN 'Missing' WHEN r.name IS NULL THEN 'Unlisted' WHEN r.d <> o.d THEN 'Modified' END AS problem
          FROM r FULL JOIN o ON r.bundle_id = o.bundle_id AND r.name = o.name) WHERE problem IS NOT NULL""",
)
def d18_verify_manifest(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.replace(pick(F.col("p_size"), _NAMES), F.lit("{n}"), k.cast("string"))
    parts = table(spark, sf, "part").select(k, F.col("p_brand").alias("bundle_id"), name.alias("name"))
    recorded = parts.filter(k % 7 != 0).withColumn("sha256", F.sha2("name", 256))
    recorded = recorded.unionByName(recorded.filter(k % 19 == 0))
    observed = parts.filter(k % 5 != 0).select(
        "bundle_id", "name", F.sha2(F.when(k % 11 == 0, "x").otherwise(F.col("name")), 256).alias("sha256"),
        F.when(k % 23 == 0, "link").otherwise("file").alias("kind"),
    )
    return compare.verify_manifest(recorded, observed)


_USES = ["=[Nation_{n}.A1]", "=SUM('nation_{n}'.B2)", "#NATION_{n}", "#'nation_{n}'", "nation_{n}", "xNATION_{n}.C3", ""]


@query(
    "d19_name_referenced",
    f"""WITH n AS (SELECT doc_id, n_name AS name FROM documents JOIN nation ON n_nationkey IN (doc_id % 25, (doc_id + 1) % 25)),
        v AS (SELECT doc_id, text AS value FROM documents UNION ALL
          SELECT doc_id, replace({pick_sql("doc_id", _USES)}, '{{n}}', (doc_id % 25)::VARCHAR) FROM documents),
        s AS (SELECT doc_id, name, lower(name) AS s FROM n UNION ALL SELECT doc_id, name, '''' || lower(name) || '''' FROM n)
        SELECT DISTINCT s.doc_id, name FROM s JOIN v USING (doc_id) WHERE contains(lower(value), s || '.') OR lower(value) = '#' || s""",
)
def d19_name_referenced(spark: SparkSession, sf: str) -> DataFrame:
    """Names that whole texts or injected formulas may refer to."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    keys = docs.select("doc_id", F.explode(F.array(k % 25, (k + 1) % 25)).alias("key"))
    names = keys.join(nation, "key").select("doc_id", "name")
    used = F.replace(pick(k, _USES), F.lit("{n}"), (k % 25).cast("string"))
    values = docs.select("doc_id", F.col("text").alias("value")).unionByName(docs.select("doc_id", used.alias("value")))
    return references.name_referenced(names, values)


@query(
    "d20_rename_conflicts",
    """WITH n AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'Twin' ELSE c_name END AS name FROM customer),
       r AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 10 = 0 THEN 'Twin' WHEN c_custkey % 22 = 0 THEN 'Gone' || c_custkey ELSE c_name END AS old,
         CASE c_custkey % 7 WHEN 0 THEN 'New' || c_custkey WHEN 1 THEN upper(c_name) WHEN 2 THEN c_name WHEN 3 THEN 'Same' WHEN 4 THEN 'TWIN'
           ELSE 'Customer#' || lpad((c_custkey * 7 % 3000)::VARCHAR, 9, '0') END AS new FROM customer),
       have AS (SELECT doc_id, name AS old, count(*) AS same FROM n GROUP BY 1, 2),
       fold AS (SELECT doc_id, lower(name) AS k, count(DISTINCT name) AS sp, min(name) AS one FROM n GROUP BY 1, 2),
       asked AS (SELECT doc_id, lower(new) AS k, count(*) AS a FROM r GROUP BY 1, 2),
       olds AS (SELECT doc_id, lower(old) AS k, count(DISTINCT old) AS os, min(old) AS oone FROM r GROUP BY 1, 2)
       SELECT r.doc_id, r.old, r.new, CASE WHEN same IS NULL THEN 'unknown' WHEN same > 1 THEN 'ambiguous' WHEN os > 1 OR oone <> r.old THEN 'chained'
         WHEN a > 1 THEN 'shared target' WHEN r.old <> r.new AND (sp > 1 OR one <> r.old) THEN 'taken' END AS reason
       FROM r LEFT JOIN have USING (doc_id, old) LEFT JOIN fold f ON f.doc_id = r.doc_id AND f.k = lower(r.new)
       LEFT JOIN asked a ON a.doc_id = r.doc_id AND a.k = lower(r.new) LEFT JOIN olds o ON o.doc_id = r.doc_id AND o.k = lower(r.new)""",
)
def d20_rename_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    customers = table(spark, sf, "customer")
    twin = F.when(k % 10 == 0, "Twin")
    names = customers.select(F.col("c_nationkey").alias("doc_id"), F.coalesce(twin, name).alias("name"))
    other = F.concat(F.lit("Customer#"), F.lpad((k * 7 % 3000).cast("string"), 9, "0"))
    new = (
        F.when(k % 7 == 0, F.concat(F.lit("New"), k)).when(k % 7 == 1, F.upper(name)).when(k % 7 == 2, name)
        .when(k % 7 == 3, "Same").when(k % 7 == 4, "TWIN").otherwise(other)
    )
    renames = customers.select(
        F.col("c_nationkey").alias("doc_id"), F.coalesce(twin, F.when(k % 22 == 0, F.concat(F.lit("Gone"), k)), name).alias("old"), new.alias("new")
    )
    return update.rename_conflicts(names, renames)


@query(
    "d21_boundary_safety",
    f"""WITH {RUNS}, b AS (SELECT DISTINCT user_id AS doc_id, 20 + user_id % 30 AS boundary FROM events),
        r AS (SELECT doc_id, boundary, run_end - repeat AS p, repeat AS n, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS s, event_type = 'view' AS st
          FROM runs JOIN b USING (doc_id)),
        c AS (SELECT doc_id, count(*) FILTER (WHERE s > 1 AND p < boundary AND boundary < p + n - 1 + s) AS cut_cells,
          count(*) FILTER (WHERE st AND p < boundary AND boundary < p + n) AS cut_repeats FROM r GROUP BY 1)
        SELECT * FROM c WHERE cut_cells > 0 OR cut_repeats > 0""",
)
def d21_boundary_safety(spark: SparkSession, sf: str) -> DataFrame:
    runs = value_runs(spark, sf).withColumn("span", F.when(F.col("event_id") % 3 == 0, 4).otherwise(1)).withColumn(
        "structural", F.col("event_type") == "view"
    )
    users = table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    requests = users.withColumn("boundary", F.col("doc_id") % 30 + 20)
    return grids.boundary_problems(runs, requests, ["doc_id"])


@query(
    "d22_excluded_consumers",
    """WITH b AS (SELECT l_suppkey AS doc_id, l_returnflag || l_linestatus || l_linenumber AS style, l_quantity > 10 AS sel FROM lineitem)
       SELECT doc_id, style, count(*) AS n_outside FROM b WHERE NOT sel AND style LIKE 'A%' GROUP BY 1, 2""",
)
def d22_excluded_consumers(spark: SparkSession, sf: str) -> DataFrame:
    """Styles about to change that line items outside the selection use."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("style"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("block_id"), "l_quantity",
    )
    selected = items.filter("l_quantity > 10").select("doc_id", "block_id")
    changed = items.filter(F.col("style").startswith("A")).select("doc_id", "style")
    return update.excluded_consumers(items, selected, changed)


@query(
    "d23_question_context",
    f"""WITH {FINDINGS} SELECT f.page_id, f.ord AS pos, f.rule_id, l.text AS excerpt, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS page
        FROM findings f JOIN links l USING (page_id, ord) JOIN pages p USING (page_id)""",
)
def d23_question_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding with its link's own words and the heading of its page."""
    found = page_findings(spark, sf).select(F.col("doc_id").cast("long").alias("page_id"), "pos", "rule_id")
    tags = page_tags(spark, sf).filter(~F.col("closing"))
    heads = tags.filter("tag = 'h1'").groupBy("page_id").agg(F.min_by("text", "ord").alias("page"))
    links = tags.filter("tag = 'a'").select("page_id", F.col("ord").alias("pos"), F.col("text").alias("excerpt"))
    return found.join(links, ["page_id", "pos"], "left").join(heads, "page_id", "left")


@query(
    "d23_nearest_landmarks",
    f"""WITH {FINDINGS}, m AS (SELECT page_id, ord, text, CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 'heading' ELSE 'block' END AS kind FROM tags
          WHERE NOT closing AND tag IN ('h1', 'h2', 'h3', 'p', 'li', 'div'))
        SELECT f.page_id::VARCHAR AS doc_id, f.ord AS pos, f.rule_id, arg_max(m.text, m.ord) FILTER (WHERE m.kind = 'heading' AND m.ord <= f.ord) AS heading,
          arg_max(m.text, m.ord) FILTER (WHERE m.kind = 'block' AND m.ord <= f.ord) AS block, any_value(l.text) AS excerpt
        FROM findings f JOIN links l USING (page_id, ord) LEFT JOIN m ON m.page_id = f.page_id GROUP BY 1, 2, 3""",
)
def d23_nearest_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding with the nearest heading and block before it, and its link's own words."""
    found = page_findings(spark, sf).select("doc_id", "pos", "rule_id")
    tags = page_tags(spark, sf).filter(~F.col("closing")).select(F.col("page_id").cast("string").alias("doc_id"), F.col("ord").alias("pos"), "tag", "text")
    kind = F.when(F.col("tag").isin("h1", "h2", "h3"), "heading").when(F.col("tag").isin("p", "li", "div"), "block")
    marks = tags.withColumn("kind", kind).filter("kind IS NOT NULL").withColumnRenamed("text", "name")
    excerpts = tags.filter("tag = 'a'").withColumnRenamed("text", "excerpt")
    return with_context(found, marks, ["heading", "block"], excerpts)
