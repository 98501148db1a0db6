"""Sources, ingestion and sinks over the given tables."""

from __future__ import annotations

import io
import uuid
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.registry import HREF, TAGS, query
from leafwright.functions.uri import is_relative_link
from leafwright.operators.findings import raise_rules, summary, union_findings
from leafwright.operators.nesting import with_owners
from leafwright.rules import category_of
from leafwright.rules import rules as rule_dimension
from leafwright.session import literal_frame, shared_dir, stored, table
from leafwright.sources.corpus import identify, package_members
from leafwright.sources.html import attribute, shred_html, with_tree
from leafwright.sources.records import check_batch
from leafwright.sources.sinks import publish, published, report_lines, sarif, sarif_parts
from leafwright.sources.validator import failed_rules, parse_validation, validate_reports
from leafwright.sources.xml import shred_xml

MIMETYPE = "application/vnd.oasis.opendocument.text"


def page_tags(spark: SparkSession, sf: str) -> DataFrame:
    return shred_html(table(spark, sf, "pages"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Opening anchors of every page: page_id, url, ord, href, text."""
    tags = page_tags(spark, sf).filter((F.col("tag") == "a") & ~F.col("closing"))
    return tags.select("page_id", "url", "ord", attribute(F.col("attrs"), "href").alias("href"), "text")


LINKS = f"""{TAGS},
links AS (SELECT page_id, url, ord, regexp_extract(attrs, '{HREF}', 1) AS href, text
  FROM tags WHERE tag = 'a' AND NOT closing)"""


@query(
    "a1_corpus_scan",
    """SELECT 'page/' || page_id AS doc_id, sha256(html) AS sha256, strlen(html)::BIGINT AS n_bytes,
         strlen(html) <= 20000 AS admitted FROM pages
       UNION ALL SELECT 'document/' || doc_id, sha256(text), strlen(text)::BIGINT,
         strlen(text) <= 20000 FROM documents""",
)
def a1_corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every page and document with its digest; a low bound shows refused rows are kept."""
    pages = table(spark, sf, "pages")
    docs = table(spark, sf, "documents")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = [
        identify(pages, key("page/", "page_id"), F.col("url"), F.col("html"), 20_000),
        identify(docs, key("document/", "doc_id"), F.col("source"), F.col("text"), 20_000),
    ]
    return rows[0].unionByName(rows[1]).select("doc_id", "sha256", "n_bytes", "admitted")


def _pack(doc_id: int, text: str, source: str, lang: str) -> bytes:
    """A small package around one document; which members it lacks depends on its id."""
    plan: list[tuple[str, str, bool]] = []
    if doc_id % 13:
        plan.append(("content.xml", text, False))
    plan.append(("META-INF/manifest.xml", "<m/>", False))
    if doc_id % 3:
        plan.append(("styles.xml", source, False))
    plan.append(("meta.xml", lang, False))
    if doc_id % 17 == 0:
        plan.append(("meta.xml", lang, False))
    if doc_id % 19 == 0:
        plan.append(("../evil", "x", False))
    if doc_id % 11:
        mime = ("mimetype", MIMETYPE + (" " if doc_id % 7 == 0 else ""), doc_id % 4 != 0)
        plan.insert(len(plan) if doc_id % 5 == 0 else 0, mime)
    buffer = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(buffer, "w") as archive:
        warnings.simplefilter("ignore")
        for name, data, stored in plan:
            kind = zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED
            archive.writestr(zipfile.ZipInfo(name), data, compress_type=kind)
    return buffer.getvalue()


def packages(spark: SparkSession, sf: str) -> DataFrame:
    """Packages Spark derives from the documents table, one per document."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = batch[["doc_id", "text", "source", "lang"]].itertuples(index=False)
            content = [_pack(*row) for row in cells]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "content": content})

    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    built = docs.mapInPandas(build, "doc_id string, content binary")
    return identify(built, F.col("doc_id"), F.col("doc_id"), F.col("content"))


PACKAGES = f"""
planned AS (
  SELECT doc_id, 0 AS p, 'mimetype' AS name, doc_id % 4 <> 0 AS stored,
    '{MIMETYPE}' || CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE '' END AS data
  FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 9, 'mimetype', doc_id % 4 <> 0,
    '{MIMETYPE}' || CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE '' END
  FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 = 0
  UNION ALL SELECT doc_id, 1, 'content.xml', false, text FROM documents WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id, 2, 'META-INF/manifest.xml', false, '<m/>' FROM documents
  UNION ALL SELECT doc_id, 3, 'styles.xml', false, source FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, 4, 'meta.xml', false, lang FROM documents
  UNION ALL SELECT doc_id, 5, 'meta.xml', false, lang FROM documents WHERE doc_id % 17 = 0
  UNION ALL SELECT doc_id, 6, '../evil', false, 'x' FROM documents WHERE doc_id % 19 = 0),
members AS (
  SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS ord,
    name, stored, data FROM planned)
"""


@query(
    "a2_package_members",
    f"""WITH {PACKAGES} SELECT doc_id, ord::BIGINT AS ord, name, strlen(data)::BIGINT AS size, stored,
      sha256(data) AS sha256 FROM members""",
)
def a2_package_members(spark: SparkSession, sf: str) -> DataFrame:
    members = package_members(packages(spark, sf))
    return members.select("doc_id", F.col("ord").cast("long"), "name", "size", "stored", "sha256")


FLAT = "','".join(
    "area base br col embed hr img input link meta source track wbr "
    "p b i em strong span u s small font option dt dd".split()
)
TREE = f"""{TAGS},
deep AS (SELECT *, tag NOT IN ('{FLAT}') AS lvl,
  coalesce(sum(CASE WHEN tag IN ('{FLAT}') THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (
    PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1
    AS depth FROM tags),
ends AS (
  SELECT page_id, ord, depth AS k, false AS opener FROM deep WHERE NOT closing
  UNION ALL SELECT page_id, ord, depth + 1, true FROM deep WHERE NOT closing AND lvl),
found AS (SELECT *, max(CASE WHEN opener THEN ord END) OVER (
    PARTITION BY page_id, k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_ord
  FROM ends),
tree AS (SELECT d.page_id, d.url, d.ord, d.tag, d.attrs, d.text, d.depth, f.parent_ord, q.tag AS parent_tag
  FROM deep d JOIN found f ON f.page_id = d.page_id AND f.ord = d.ord AND NOT f.opener
  LEFT JOIN tags q ON q.page_id = d.page_id AND q.ord = f.parent_ord WHERE NOT d.closing)"""


@query(
    "a3_html_nodes",
    f"""WITH {TREE} SELECT page_id, ord, tag, depth, parent_ord, parent_tag,
      length(text)::BIGINT AS text_length FROM tree""",
)
def a3_html_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Tag events of every page as a tree."""
    tree = with_tree(page_tags(spark, sf))
    return tree.select(
        "page_id", "ord", "tag", "depth", "parent_ord", "parent_tag",
        F.length("text").cast("long").alias("text_length"),
    )


def document_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Flat XML documents Spark derives from the documents table (doc_id, part, content)."""
    escape = F.col("text")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escape = F.replace(escape, F.lit(raw), F.lit(safe))
    paragraphs = F.transform(
        F.split(escape, "\n"),
        lambda line, i: F.concat(
            F.lit('<text:p text:style-name="S'), (i % 3).cast("string"), F.lit('">'), line,
            F.lit("</text:p>"),
        ),
    )
    ns = "urn:oasis:names:tc:opendocument:xmlns:"
    head = (
        f'<office:document xmlns:office="{ns}office:1.0" xmlns:text="{ns}text:1.0" '
        'office:version="1.3"><office:body><office:text>'
    )
    foot = "</office:text></office:body></office:document>"
    declared = F.when(F.col("doc_id") % 50 == 0, "<!DOCTYPE x>").otherwise("")
    xml = F.concat(declared, F.lit(head), F.array_join(paragraphs, ""), F.lit(foot))
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("content").alias("part"), xml.alias("content")
    )


@query(
    "a3_xml_nodes",
    """WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
         SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 50 <> 0))
       SELECT doc_id::VARCHAR AS doc_id, 3 + i::BIGINT AS node_id, 3::BIGINT AS parent_id,
         i::BIGINT AS ord, 4::BIGINT AS depth, 'text:p' AS tag, nullif(line, '') AS text,
         'S' || ((i - 1) % 3) AS style, 'office:document/office:body/office:text' AS above,
         NULL::VARCHAR AS problem FROM lines
       UNION ALL SELECT d.doc_id::VARCHAR, v.n, nullif(v.n - 1, 0), 1, v.n, v.tag, NULL, NULL, v.above, NULL
         FROM documents d, (VALUES (1, 'office:document', ''), (2, 'office:body', 'office:document'),
           (3, 'office:text', 'office:document/office:body')) v(n, tag, above) WHERE d.doc_id % 50 <> 0
       UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ExpatError'
         FROM documents WHERE doc_id % 50 = 0""",
)
def a3_xml_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Flat XML shredded to nodes; documents with a type declaration give one problem row."""
    nodes = stored(shred_xml(document_xml(spark, sf)))
    key = ["doc_id", "part", "node_id"]
    # The path is spelled out from the pairs of the structural join: every element with those above it.
    pairs = with_owners(nodes.filter("problem IS NULL").select(*key, "last_id", "tag"), F.lit(True))
    steps = F.sort_array(F.collect_list(F.struct("owner_id", "owner_tag")))
    paths = pairs.filter("owner_id <> node_id").groupBy(*key).agg(
        F.array_join(F.transform(steps, lambda s: s["owner_tag"]), "/").alias("above")
    )
    placed = nodes.join(paths, key, "left")
    return placed.select(
        "doc_id", "node_id", "parent_id", F.col("ord").cast("long"), F.col("depth").cast("long"),
        "tag", "text", F.col("attrs")["text:style-name"].alias("style"),
        F.when(F.col("problem").isNull(), F.coalesce("above", F.lit(""))).alias("above"), "problem",
    )


def validation_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Validator reports Spark derives from the documents: one rule per line of text."""
    failed = lambda line: F.length(line) % 2 == 0
    lines = F.split("text", "\n")
    rule = lambda line, i: F.concat(
        F.lit('<rule specification="ISO 14289-1" clause="7.'), (i + 1).cast("string"),
        F.lit('" testNumber="'), (F.length(line) % 5).cast("string"), F.lit('" status="'),
        F.when(failed(line), "failed").otherwise("passed"), F.lit('" failedChecks="1"><description>'),
        F.col("lang"), F.lit('</description><check status="failed"><context>c'),
        F.length(line).cast("string"), F.lit("</context><errorMessage>m</errorMessage></check></rule>"),
    )
    n_failed = F.size(F.filter(lines, failed))
    declared = n_failed + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    xml = F.concat(
        F.lit('<validationReport isCompliant="'), F.when(declared == 0, "true").otherwise("false"),
        F.lit('" jobEndStatus="'), F.when(F.col("doc_id") % 31 == 0, "timeout").otherwise("normal"),
        F.lit('" profileName="UA-1"><details failedRules="'), declared.cast("string"), F.lit('">'),
        F.array_join(F.transform(lines, rule), ""), F.lit("</details></validationReport>"),
    )
    return parse_validation(table(spark, sf, "documents").select("doc_id", xml.alias("xml")), "xml")


REPORTS = """lines AS (SELECT doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"""


@query(
    "a4_validator_rules",
    f"""WITH {REPORTS} SELECT doc_id, (i - 1)::BIGINT AS rule_ord, '7.' || i AS clause,
         (length(line) % 5)::VARCHAR AS test_number, lang AS description, 1::BIGINT AS failed_checks,
         'c' || length(line) AS contexts FROM lines WHERE length(line) % 2 = 0""",
)
def a4_validator_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = failed_rules(validation_reports(spark, sf))
    return rows.select(
        "doc_id", "rule_ord", "clause", "test_number", "description", "failed_checks",
        F.array_join("contexts", "|").alias("contexts"),
    )


@query(
    "e18_validator_verdicts",
    f"""WITH {REPORTS}, n AS (SELECT doc_id, count(*) FILTER (WHERE length(line) % 2 = 0) AS failed
         FROM lines GROUP BY 1),
       r AS (SELECT doc_id, failed + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS declared, failed FROM n)
       SELECT doc_id, declared = 0 AS compliant,
         CASE WHEN doc_id % 31 = 0 THEN 'job ended abnormally'
              WHEN declared <> failed THEN 'inconsistent' END AS problem,
         CASE WHEN doc_id % 31 = 0 OR declared <> failed THEN 3 WHEN declared = 0 THEN 0 ELSE 2 END::BIGINT
           AS status FROM r""",
)
def e18_validator_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = validate_reports(validation_reports(spark, sf))
    return rows.withColumn("status", F.col("status").cast("long"))


EVENT_RULES = [
    ("click", "LINK002"),
    ("view", "HEADING003"),
    ("error", "PKG001"),
    ("signup", "META003"),
    ("purchase", "FIDELITY006"),
]


def event_rules(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, EVENT_RULES, "event_type string, rule_id string")


EVENT_RULES_SQL = """(VALUES ('click', 'LINK002', 'warning'), ('view', 'HEADING003', 'error'),
  ('error', 'PKG001', 'error'), ('signup', 'META003', 'warning'), ('purchase', 'FIDELITY006', 'info'))
  r(event_type, rule_id, severity)"""


@query(
    "a5_rule_dimension",
    f"""SELECT r.rule_id, r.severity, lower(regexp_replace(r.rule_id, '[0-9]+$', '')) AS category,
         count(*) AS n FROM events e JOIN {EVENT_RULES_SQL} USING (event_type) GROUP BY ALL
       UNION ALL SELECT upper(p_brand), NULL, lower(regexp_replace(upper(p_brand), '[0-9]+$', '')),
         count(*) FROM part GROUP BY ALL""",
)
def a5_rule_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Rule lookup of every event, and the category rule over unknown identifiers."""
    events = table(spark, sf, "events").join(event_rules(spark), "event_type")
    brands = table(spark, sf, "part").select(F.upper("p_brand").alias("rule_id"))
    both = events.select("rule_id").unionByName(brands)
    counted = both.groupBy("rule_id").agg(F.count("*").alias("n"))
    known = counted.join(rule_dimension(spark).drop("category"), "rule_id", "left")
    return known.select("rule_id", "severity", category_of(F.col("rule_id")).alias("category"), "n")


@query(
    "a6_batch_records",
    """WITH c AS (SELECT c_custkey, c_mktsegment AS batch_id,
         CASE WHEN c_custkey % 10 = 0 THEN c_name WHEN c_custkey % 97 = 1 THEN 'com3'
              WHEN c_custkey % 13 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'twin-' ELSE 'TWIN-' END
                || (c_custkey % 5) ELSE replace(c_name, '#', '_') END AS id,
         CASE WHEN c_custkey % 17 = 0 THEN '/abs/x.odt' WHEN c_custkey % 19 = 0 THEN 'C:x.odt'
              ELSE 'in/' || c_custkey || '.odt' END AS source, c_custkey % 11 = 0 AS extra FROM customer),
       d AS (SELECT batch_id, lower(id) AS k FROM c GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT c.batch_id, c.id, CASE WHEN extra THEN 'keys'
         WHEN NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_-]{0,63}') OR id = 'com3' THEN 'id'
         WHEN d.k IS NOT NULL THEN 'duplicate id'
         WHEN source LIKE '/%' OR source LIKE 'C:%' THEN 'path' END AS problem
       FROM c LEFT JOIN d ON d.batch_id = c.batch_id AND d.k = lower(c.id)""",
)
def a6_batch_records(spark: SparkSession, sf: str) -> DataFrame:
    """Batch records written as JSON from the customers and read back strictly."""
    key = F.col("c_custkey")
    twin = F.concat(F.when(key % 2 == 0, "twin-").otherwise("TWIN-"), (key % 5).cast("string"))
    identity = (
        F.when(key % 10 == 0, F.col("c_name"))
        .when(key % 97 == 1, "com3")
        .when(key % 13 == 0, twin)
        .otherwise(F.replace("c_name", F.lit("#"), F.lit("_")))
    )
    source = (
        F.when(key % 17 == 0, "/abs/x.odt")
        .when(key % 19 == 0, "C:x.odt")
        .otherwise(F.concat(F.lit("in/"), key.cast("string"), F.lit(".odt")))
    )
    fields = F.struct(
        identity.alias("id"), source.alias("source"), F.lit("p.json").alias("plan"),
        F.when(key % 11 == 0, "1").alias("note"),
    )
    raw = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("batch_id"), F.to_json(fields).alias("record")
    )
    return check_batch(raw).select("batch_id", "id", "problem")


def page_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings about pages: site-relative links and non-ASCII link targets."""
    links = page_links(spark, sf).withColumn("doc_id", F.col("page_id").cast("string"))
    path = F.concat(F.lit("content/link["), F.col("ord"), F.lit("]"))
    tests = {
        "NATIVE003": is_relative_link(F.col("href")),
        "FIDELITY008": F.col("href").rlike("[^\\x00-\\x7f]"),
    }
    details = {"NATIVE003": {"text": F.col("text")}, "FIDELITY008": {"problem": F.col("href")}}
    return union_findings(
        raise_rules(links, tests, path=path, pos=F.col("ord"), details=details)
    )


FINDINGS = rf"""{LINKS},
findings AS (
  SELECT page_id, ord, 'NATIVE003' AS rule_id, 'warning' AS severity FROM links
    WHERE href <> '' AND NOT starts_with(href, '#') AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:')
  UNION ALL SELECT page_id, ord, 'FIDELITY008', 'error' FROM links
    WHERE regexp_matches(href, '[^\x00-\x7f]')),
langs AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages)"""


@query(
    "a7_report_lines",
    f"""WITH {FINDINGS}, s AS (SELECT p.page_id::VARCHAR AS doc_id,
         count(*) FILTER (WHERE severity = 'error') AS errors,
         count(*) FILTER (WHERE severity = 'warning') AS warnings,
         count(*) FILTER (WHERE severity = 'info') AS info
         FROM pages p LEFT JOIN findings f USING (page_id) GROUP BY 1)
       SELECT doc_id, errors, warnings, info, '{{"schema_version":1,"kind":"odf","subject":"' || doc_id ||
         '","summary":{{"errors":' || errors || ',"warnings":' || warnings || ',"info":' || info || '}}}}'
         AS report FROM s""",
)
def a7_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"))
    return report_lines(page_findings(spark, sf), docs, "odf")


def _page_language(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    pages = table(spark, sf, "pages")
    return pages.select("page_id", "url", lang.alias("run"), F.col("page_id").cast("string").alias("doc_id"))


def page_sarif(spark: SparkSession, sf: str) -> DataFrame:
    joined = stored(page_findings(spark, sf).join(_page_language(spark, sf), "doc_id"))
    return sarif(joined.withColumn("file", F.concat_ws("", F.lit("p/"), "doc_id")), "run", "page_id", "file")


@query(
    "a8_sarif_results",
    f"""WITH {FINDINGS}, j AS (SELECT f.*, lang FROM findings f JOIN langs USING (page_id)),
       ru AS (SELECT lang, rule_id, row_number() OVER (PARTITION BY lang ORDER BY rule_id) - 1 AS rule_index
         FROM (SELECT DISTINCT lang, rule_id FROM j)),
       ar AS (SELECT lang, page_id, row_number() OVER (PARTITION BY lang ORDER BY page_id) - 1 AS artifact_index
         FROM (SELECT DISTINCT lang, page_id FROM j))
       SELECT j.lang AS run, j.rule_id, rule_index, artifact_index, severity AS level,
         'content/link[' || ord || ']' AS path, 'p%2F' || page_id AS uri, ord AS pos, true AS safe
       FROM j JOIN ru USING (lang, rule_id) JOIN ar USING (lang, page_id)""",
)
def a8_sarif_results(spark: SparkSession, sf: str) -> DataFrame:
    return page_sarif(spark, sf).drop("category")


@query(
    "a8_sarif_parts",
    f"""WITH {FINDINGS}, j AS (SELECT f.*, lang FROM findings f JOIN langs USING (page_id)),
       n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY page_id, ord, rule_id) - 1 AS n FROM j)
       SELECT lang AS run, (n // 100)::BIGINT AS part, count(*) AS n_results FROM n GROUP BY 1, 2""",
)
def a8_sarif_parts(spark: SparkSession, sf: str) -> DataFrame:
    """SARIF results in bounded parts, so no run has to fit one task."""
    rows = page_sarif(spark, sf)
    parts = sarif_parts(rows, "run", ["artifact_index", "pos", "rule_id"], 100)
    return parts.select("run", "part", "n_results")


@query(
    "a9_publication_state",
    f"""WITH {FINDINGS}, v AS (SELECT page_id, count(*) AS n FROM findings WHERE severity = 'error' GROUP BY 1)
       SELECT p.page_id, coalesce(n, 0) AS n_violations,
         CASE WHEN n IS NULL THEN 'preview' ELSE 'refused' END AS state
       FROM pages p LEFT JOIN v USING (page_id)""",
)
def a9_publication_state(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages a guarded publication would refuse: those with an error finding."""
    from leafwright.operators.update import guarded_candidate

    pages = table(spark, sf, "pages").select("page_id", "url")
    errors = page_findings(spark, sf).filter("severity = 'error'")
    violations = errors.select(F.col("doc_id").cast("long").alias("page_id"))
    return guarded_candidate(pages, pages, violations, "page_id")[0]


@query(
    "a9_publication_log",
    f"""WITH {FINDINGS}, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE severity = 'error') AS e FROM findings)
       SELECT unnest([1, 2, 3, 4, 5]) AS attempt, unnest(['PREVIEW', 'REFUSED', 'PUBLISHED', 'REFUSED', 'PUBLISHED']) AS state,
         unnest([0, 0, a, a, e])::BIGINT AS n_rows FROM n""",
)
def a9_publication_log(spark: SparkSession, sf: str) -> DataFrame:
    """Five attempts at one destination and the rows a reader sees after each."""
    found = stored(page_findings(spark, sf).select("doc_id", "rule_id", "pos", "severity"))
    errors = found.filter("severity = 'error'")
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    attempts = [(found, {"dry_run": True}), (found, {"violations": found}), (found, {}), (errors, {}), (errors, {"replace": True})]
    log = None
    for number, (rows, options) in enumerate(attempts, 1):
        state = publish(rows, path, **options)
        seen = published(spark, path)
        counted = spark.range(1).select(F.lit(0).cast("long").alias("n_rows")) if seen is None else seen.agg(F.count("*").alias("n_rows"))
        entry = counted.select(F.lit(number).alias("attempt"), F.lit(state).alias("state"), "n_rows")
        log = entry if log is None else log.unionByName(entry)
    return log


@query(
    "e1_severity_summary",
    f"""WITH {FINDINGS} SELECT page_id::VARCHAR AS doc_id, count(*) FILTER (WHERE severity = 'error') AS errors,
         count(*) FILTER (WHERE severity = 'warning') AS warnings,
         count(*) FILTER (WHERE severity = 'info') AS info FROM findings GROUP BY 1""",
)
def e1_severity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summary(page_findings(spark, sf))


@query(
    "h4_findings_union",
    f"""WITH {FINDINGS} SELECT page_id::VARCHAR AS doc_id, rule_id, severity,
         lower(regexp_replace(rule_id, '[0-9]+$', '')) AS category, ord AS pos FROM findings""",
)
def h4_findings_union(spark: SparkSession, sf: str) -> DataFrame:
    return page_findings(spark, sf).select("doc_id", "rule_id", "severity", "category", "pos")


@query(
    "i3_details_map",
    f"""WITH {FINDINGS} SELECT f.page_id::VARCHAR AS doc_id, f.ord AS pos, f.rule_id,
         CASE WHEN f.rule_id = 'NATIVE003' THEN 'text' ELSE 'problem' END AS key,
         CASE WHEN f.rule_id = 'NATIVE003' THEN left(l.text, 4096) ELSE left(l.href, 4096) END AS value
       FROM findings f JOIN links l USING (page_id, ord)
       UNION ALL SELECT user_id::VARCHAR, event_id, event_type, 'k', json_extract_string(props, '$.k')
       FROM events""",
)
def i3_details_map(spark: SparkSession, sf: str) -> DataFrame:
    """Details as key/value rows: of findings, and of the events' JSON properties."""
    found = page_findings(spark, sf).select(
        "doc_id", "pos", "rule_id", F.explode("details").alias("key", "value")
    )
    props = F.from_json("props", "map<string,string>")
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("pos"),
        F.col("event_type").alias("rule_id"), F.explode(props).alias("key", "value"),
    )
    return found.unionByName(events)
