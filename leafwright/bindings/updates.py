"""Guarded updates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.registry import query, words_sql
from leafwright.bindings.scalars import ADDR, LINES, TRIM, lines, pick, pick_sql
from leafwright.operators import edits, status, update
from leafwright.operators.sequence import ordinal
from leafwright.session import stored, table


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Bound answers Spark derives from all customers: new names and segments; a null field keeps its value."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("New "), "c_name")).when(k % 4 == 1, F.col("c_name"))
    segment = F.when(k % 6 == 0, F.lit("REVIEWED"))
    real = customers(spark, sf).select(k, name.alias("c_name"), segment.alias("c_mktsegment"))
    lost = customers(spark, sf).filter(k % 100 == 0).select((k + 10_000_000).alias("c_custkey"), F.lit("x").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return real.unionByName(lost)


ANSWERED = """b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'New ' || c_name WHEN c_custkey % 4 = 1 THEN c_name END AS n,
    CASE WHEN c_custkey % 6 = 0 THEN 'REVIEWED' END AS s FROM customer)"""


@query(
    "k1_apply_answers",
    f"""WITH {ANSWERED} SELECT c.c_custkey, coalesce(n, c_name) AS c_name, c_nationkey, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN b USING (c_custkey)""",
)
def k1_apply_answers(spark: SparkSession, sf: str) -> DataFrame:
    return update.apply_answers(customers(spark, sf), answered(spark, sf), "c_custkey", ["c_name", "c_mktsegment"])[0]


@query(
    "k1_outcomes",
    f"""WITH {ANSWERED} SELECT c_custkey, CASE WHEN coalesce(n <> c_name, false) OR coalesce(s <> c_mktsegment, false) THEN 'applied' ELSE 'unchanged' END AS status,
         (coalesce(n <> c_name, false) OR coalesce(s <> c_mktsegment, false))::BIGINT AS count FROM b JOIN customer USING (c_custkey)
        UNION ALL SELECT c_custkey + 10000000, 'failed', 0 FROM customer WHERE c_custkey % 100 = 0""",
)
def k1_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return update.apply_answers(customers(spark, sf), answered(spark, sf), "c_custkey", ["c_name", "c_mktsegment"])[1]


def paragraph_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents as paragraphs, every fifth with addresses, every sixth empty."""
    pos = F.col("pos")
    text = F.when(pos % 6 == 2, " ").when(pos % 5 == 0, F.concat("text", F.lit(" see (https://ex.org/a(b).),; or a.b@c.de."))).otherwise(F.col("text"))
    place = F.array(pos)
    return lines(spark, sf).select(
        edits.row_id(F.col("doc_id"), place).alias("row_id"), "doc_id", place.alias("place"), F.lit("p").alias("kind"), text.alias("text"),
        F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("parent"), F.col("doc_id").alias("table_id"), "pos",
        (pos % 4 == 0).alias("breaks"), F.lit(False).alias("protected"),
    )


def typed_edits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spacers dropped, header rows grouped and addresses linked, one edit after the other."""
    rows = paragraph_rows(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id").distinct()
    kept, removed, first = edits.drop_spacers(rows, docs.filter("doc_id % 2 = 0"))
    kept = stored(ordinal(kept, ["doc_id"], "pos", "y"))
    wanted = docs.select("doc_id", F.col("doc_id").alias("table_id"), (F.col("doc_id") % 4).alias("headers"))
    headed, grouped, second = edits.header_rows(kept, wanted)
    linked, split, third = edits.linkify_rows(headed, docs)
    return linked, removed.unionByName(grouped).unionByName(split), first.unionByName(second).unionByName(third)


_EDITED = (
    TRIM.format(
        source=f"""{LINES}, para AS (SELECT doc_id, pos, CASE WHEN pos % 6 = 2 THEN ' ' WHEN pos % 5 = 0 THEN text || ' see (https://ex.org/a(b).),; or a.b@c.de.' ELSE text END AS text
             FROM lines),
           kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS y, count(*) OVER (PARTITION BY doc_id) AS n, min(pos) OVER (PARTITION BY doc_id) AS p FROM para
             WHERE NOT (doc_id % 2 = 0 AND {words_sql("text")} = '' AND pos % 4 <> 0)),
           raw AS (SELECT doc_id, pos, unnest(a) AS raw, generate_subscripts(a, 1)::BIGINT AS n FROM (SELECT doc_id, pos, regexp_extract_all(text, '{ADDR}') AS a FROM kept))""",
        key="doc_id, pos, n",
    )
    + f""", fenced AS (SELECT doc_id, pos, string_split_regex(regexp_replace(text, '({ADDR})', chr(57344) || '\1' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS p FROM kept),
       pieces AS (SELECT doc_id, pos, unnest(p) AS piece, generate_subscripts(p, 1)::BIGINT - 1 AS i FROM fenced),
       parts AS (SELECT * FROM (SELECT doc_id, pos, i * 2 AS segment, piece AS words, NULL AS href FROM pieces WHERE i % 2 = 0
         UNION ALL SELECT p.doc_id, p.pos, i * 2, token, CASE WHEN regexp_matches(token, '(?i)^https?://') THEN token ELSE 'mailto:' || token END
           FROM pieces p JOIN cut c ON c.doc_id = p.doc_id AND c.pos = p.pos AND c.n = (i + 1) // 2 WHERE i % 2 = 1
         UNION ALL SELECT p.doc_id, p.pos, i * 2 + 1, substr(raw, length(token) + 1), NULL
           FROM pieces p JOIN cut c ON c.doc_id = p.doc_id AND c.pos = p.pos AND c.n = (i + 1) // 2 WHERE i % 2 = 1) WHERE length(words) > 0),
       news AS (SELECT * FROM parts WHERE segment > 0 OR href IS NOT NULL),
       lead AS (SELECT doc_id, pos, max(CASE WHEN segment = 0 AND href IS NULL THEN words ELSE '' END) AS lead FROM parts GROUP BY 1, 2 HAVING bool_or(segment > 0 OR href IS NOT NULL)),
       head AS (SELECT DISTINCT doc_id, doc_id || '/' || (p - 1) || '.0' AS wrapper, doc_id % 4 AS h FROM kept WHERE doc_id % 4 BETWEEN 1 AND n - 1)"""
)


@query(
    "k1_typed_edits",
    f"""WITH {_EDITED}
       SELECT k.doc_id, pos::VARCHAR AS place, 'p' AS kind, coalesce(lead, text) AS text, NULL AS href, CASE WHEN y <= h THEN wrapper END AS parent
         FROM kept k LEFT JOIN lead USING (doc_id, pos) LEFT JOIN head USING (doc_id)
       UNION ALL SELECT doc_id, pos || '.' || (segment + 1), CASE WHEN href IS NULL THEN 'text' ELSE 'link' END, words, href, doc_id || '/' || pos FROM news
       UNION ALL SELECT doc_id, split_part(wrapper, '/', 2), 'header', NULL, NULL, NULL FROM head""",
)
def k1_typed_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Every document after three edits that insert, drop and group rows; no other row's place changes."""
    place = F.array_join(F.transform("place", lambda n: n.cast("string")), ".")
    return typed_edits(spark, sf)[0].select("doc_id", place.alias("place"), "kind", "text", "href", "parent")


@query(
    "k3_typed_edits",
    f"""WITH {_EDITED}
       SELECT reason, count(*) AS n FROM (
         SELECT 'protected column' AS reason FROM kept WHERE pos % 97 = 3
         UNION ALL SELECT 'created' FROM kept WHERE pos % 89 = 5
         UNION ALL SELECT 'unlisted row' FROM kept k LEFT JOIN lead USING (doc_id, pos) LEFT JOIN head USING (doc_id)
           WHERE lead IS NULL AND NOT coalesce(y <= h, false) AND pos % 83 = 7 AND pos % 97 <> 3) GROUP BY 1""",
)
def k3_typed_edits(spark: SparkSession, sf: str) -> DataFrame:
    """What a spoiled candidate changes beyond the edits' own allowance; the edits alone change nothing else."""
    after, allowed, _ = typed_edits(spark, sf)
    pos, own = F.col("pos"), F.col("kind") == "p"
    spoiled = after.withColumn("breaks", F.when(own & (pos % 97 == 3), ~F.col("breaks")).otherwise(F.col("breaks"))).withColumn(
        "text", F.when(own & (pos % 83 == 7), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    extra = after.filter(own & (pos % 89 == 5)).withColumn("row_id", F.concat("row_id", F.lit("/copy")))
    columns = ["row_id", "kind", "text", "href", "parent", "breaks", "protected"]
    wrong = update.preserved(
        paragraph_rows(spark, sf).select(columns), spoiled.unionByName(extra).select(columns), "row_id", ["text", "parent"], allowed
    )
    return wrong.groupBy("reason").agg(F.count("*").alias("n"))


_POLICY_KINDS = ["document.metadata", "heading.level", "table.headers", "language.target", "link.description", "text.linkify_addresses"]


@query(
    "k2_plan_policy",
    f"""WITH a AS (SELECT o_custkey AS plan_id, {pick_sql("o_orderkey", _POLICY_KINDS)} AS kind, o_orderkey % 5 = 0 AS has_id, o_orderkey % 7 = 0 AS lang,
           o_custkey % 9 = 0 AS tracked FROM orders),
        g AS (SELECT plan_id, bool_or(tracked AND NOT (kind = 'document.metadata' AND NOT lang)) AS t, bool_or(kind IN ('table.headers', 'text.linkify_addresses')) AS c,
          bool_or(kind = 'language.target' OR (kind = 'link.description' AND NOT has_id)) AS s FROM a GROUP BY 1)
        SELECT plan_id, CASE WHEN t THEN 'tracked revisions' WHEN c AND s THEN 'ordinal targets beside structural edits' END AS reason FROM g""",
)
def k2_plan_policy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    answers = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("plan_id"), F.col("o_custkey").alias("doc_id"), pick(k, _POLICY_KINDS).alias("kind_id"),
        F.when(k % 5 == 0, "content/link[id=x]").otherwise("content/link[3]").alias("path"), F.when(k % 7 == 0, "en").alias("language"),
    )
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 9 == 0).alias("tracked"))
    return update.plan_policy(answers, docs)


def edited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An applied candidate spoiled on purpose, and the allowance that came with the edit."""
    k = F.col("c_custkey")
    candidate, _ = update.apply_answers(customers(spark, sf), answered(spark, sf), "c_custkey", ["c_name", "c_mktsegment"])
    spoiled = (
        candidate.filter((k % 211 != 1) & (k % 307 != 2))
        .withColumn("c_nationkey", F.when(k % 97 == 0, 99).otherwise(F.col("c_nationkey")))
        .withColumn("c_name", F.when(k % 89 == 5, "spoiled").otherwise(F.col("c_name")))
    )
    stated = answered(spark, sf).filter("c_name IS NOT NULL OR c_mktsegment IS NOT NULL")
    edits = stated.select("c_custkey", F.lit("edit").alias("permission"))
    removed = customers(spark, sf).filter(k % 307 == 2).select("c_custkey", F.lit("remove").alias("permission"))
    return spoiled, edits.unionByName(removed)


SPOILED = f"""{ANSWERED}, x AS (SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment, n IS NOT NULL OR s IS NOT NULL AS hit,
    CASE WHEN c.c_custkey % 89 = 5 THEN 'spoiled' ELSE coalesce(n, c_name) END AS n2, CASE WHEN c.c_custkey % 97 = 0 THEN 99 ELSE c_nationkey END AS k2,
    coalesce(s, c_mktsegment) AS s2, c.c_custkey % 211 = 1 OR c.c_custkey % 307 = 2 AS gone FROM customer c LEFT JOIN b USING (c_custkey))"""
VIOLATIONS = f"""{SPOILED}, v AS (SELECT c_custkey, CASE WHEN gone THEN CASE WHEN c_custkey % 307 <> 2 THEN 'removed' END WHEN k2 <> c_nationkey THEN 'protected column'
    WHEN (n2 <> c_name OR s2 <> c_mktsegment) AND NOT hit THEN 'unlisted row' END AS reason FROM x)"""


@query("k3_preservation", f"WITH {VIOLATIONS} SELECT * FROM v WHERE reason IS NOT NULL")
def k3_preservation(spark: SparkSession, sf: str) -> DataFrame:
    after, allowed = edited(spark, sf)
    return update.preserved(customers(spark, sf), after, "c_custkey", ["c_name", "c_mktsegment"], allowed)


@query(
    "k4_edit_accounting",
    f"""WITH {SPOILED}, o AS (SELECT *, coalesce(n2 <> c_name OR s2 <> c_mktsegment OR k2 <> c_nationkey, false) OR gone AS actual,
          CASE WHEN c_custkey % 4 = 0 OR c_custkey % 6 = 0 THEN true ELSE false END AS reported FROM x)
        SELECT c_custkey, reported, actual, false AS failed FROM o WHERE reported <> actual""",
)
def k4_edit_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the clean edit against the spoiled candidate."""
    before = customers(spark, sf)
    _, outcomes = update.apply_answers(before, answered(spark, sf), "c_custkey", ["c_name", "c_mktsegment"])
    after, _ = edited(spark, sf)
    return update.accounting(outcomes.filter("status <> 'failed'"), before, after, "c_custkey")


@query(
    "k5_guarded_candidate",
    f"""WITH {VIOLATIONS}, bad AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer JOIN v USING (c_custkey) WHERE reason IS NOT NULL),
        d AS (SELECT c_nationkey || '/' || c_mktsegment AS doc_id, count(reason) AS n_violations FROM customer JOIN v USING (c_custkey) GROUP BY 1)
        SELECT *, CASE WHEN n_violations > 0 THEN 'refused' ELSE 'preview' END AS state FROM d""",
)
def k5_guarded_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """One violation refuses its whole document (a nation's segment)."""
    before = customers(spark, sf)
    after, allowed = edited(spark, sf)
    wrong = update.preserved(before, after, "c_custkey", ["c_name", "c_mktsegment"], allowed)
    doc = F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("doc_id")
    docs = before.select("c_custkey", doc)
    state, _ = update.guarded_candidate(docs, docs, wrong.join(docs, "c_custkey"))
    return state


_TITLES = ["Title", " ", "bad\x01", "Ünïcode", ""]
_LANGS = ["en", "de_AT", "x!", "", "zh-Hant"]


@query(
    "k6_answer_validation",
    f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN {pick_sql("p_partkey", ["Title", " ", "bad@", "Ünïcode", ""])} END AS title0,
          CASE WHEN p_partkey % 4 <> 0 THEN {pick_sql("p_partkey // 3", _LANGS)} END AS language, CASE WHEN p_partkey % 5 <> 0 THEN p_size - 3 END AS level,
          CASE WHEN p_partkey % 3 = 0 THEN p_type END AS version, p_partkey % 12 = 0 AS decorative FROM part),
        t AS (SELECT *, CASE WHEN title0 = 'bad@' THEN 'bad' || chr(1) ELSE title0 END AS title FROM a)
        SELECT p_partkey, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'title: blank' END, CASE WHEN title LIKE 'bad%' THEN 'title: not XML text' END,
          CASE WHEN language IN ('', 'x!') THEN 'language: language' END, CASE WHEN level < 1 THEN 'level: low' END, CASE WHEN level > 10 THEN 'level: high' END,
          CASE WHEN NOT regexp_matches(version, '^[A-M]') THEN 'version: pattern' END, CASE WHEN version NOT IN ('SMALL', 'LARGE', 'MEDIUM') THEN 'version: choice' END,
          CASE WHEN title IS NULL AND language IS NULL AND level IS NULL THEN 'nothing answered' END,
          CASE WHEN decorative AND (title IS NOT NULL OR language IS NOT NULL) THEN 'decorative: exclusive' END], lambda x: x IS NOT NULL), '|') AS problems FROM t""",
)
def k6_answer_validation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    answers = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 6 != 0, pick(k, _TITLES)).alias("title"), F.when(k % 4 != 0, pick(F.floor(k / 3), _LANGS)).alias("language"),
        F.when(k % 5 != 0, F.col("p_size") - 3).alias("level"), F.when(k % 3 == 0, F.col("p_type")).alias("version"), (k % 12 == 0).alias("decorative"),
    )
    checked = update.validate_answers(
        answers,
        {
            "title": {"nonblank": True, "xml": True}, "language": {"language": True}, "level": {"range": (1, 10)},
            "version": {"pattern": "^[A-M]", "choices": ["SMALL", "LARGE", "MEDIUM"]},
        },
        ["title", "language", "level"],
        ("decorative", ["title", "language"]),
    )
    return checked.select("p_partkey", F.array_join("problems", "|").alias("problems"))


_RESULTS = ["passed", "passed", "gate-failed", "refused", "crashed", "not-applicable"]


@query(
    "k7_stage_eligibility",
    f"""WITH d AS (SELECT o_orderkey AS item, o_custkey % 3 AS level, {", ".join(f"{pick_sql(f'(o_orderkey // {i} + o_custkey)', _RESULTS)} AS r{i}" for i in range(1, 9))} FROM orders),
        s1 AS (SELECT *, r1 AS o1, r1 = 'passed' AS src FROM d),
        s2 AS (SELECT *, CASE WHEN level < 1 OR NOT src THEN 'skipped' ELSE r2 END AS o2, CASE WHEN NOT src THEN 'skipped' ELSE r3 END AS o3 FROM s1),
        s3 AS (SELECT *, o2 = 'passed' AS spdf, o3 = 'passed' AS cand FROM s2),
        s4 AS (SELECT *, CASE WHEN NOT cand THEN 'skipped' ELSE r4 END AS o4, CASE WHEN level < 1 OR NOT cand THEN 'skipped' ELSE r5 END AS o5 FROM s3),
        s5 AS (SELECT *, o5 = 'passed' AS cpdf FROM s4),
        f AS (SELECT item, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS ord,
          unnest(['audit-source', 'export-source', 'remediate', 'audit-remediated', 'export-remediated', 'audit-pdf', 'validate-pdf', 'fidelity']) AS stage,
          unnest([o1, o2, o3, o4, o5, CASE WHEN level < 1 OR NOT cpdf THEN 'skipped' ELSE r6 END, CASE WHEN level < 2 OR NOT cpdf THEN 'skipped' ELSE r7 END,
            CASE WHEN level < 1 OR NOT spdf OR NOT cpdf THEN 'skipped' ELSE r8 END]) AS outcome,
          unnest([NULL, CASE WHEN level < 1 THEN 'profile' WHEN NOT src THEN 'missing-input' END, CASE WHEN NOT src THEN 'missing-input' END, CASE WHEN NOT cand THEN 'missing-input' END,
            CASE WHEN level < 1 THEN 'profile' WHEN NOT cand THEN 'missing-input' END, CASE WHEN level < 1 THEN 'profile' WHEN NOT cpdf THEN 'missing-input' END,
            CASE WHEN level < 2 THEN 'profile' WHEN NOT cpdf THEN 'missing-input' END, CASE WHEN level < 1 THEN 'profile' WHEN NOT spdf OR NOT cpdf THEN 'missing-input' END]) AS reason,
          unnest([NULL, 'audit-source', 'audit-source', 'remediate', 'remediate', 'export-remediated', 'export-remediated', CASE WHEN NOT spdf THEN 'export-source' ELSE 'export-remediated' END]) AS prod FROM s5)
        SELECT item, ord::BIGINT AS ord, stage, outcome, reason, CASE WHEN reason = 'missing-input' THEN prod END AS producer FROM f""",
)
def k7_stage_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs: profile level and each stage's own outcome come from the keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    docs = table(spark, sf, "orders").select(
        k.alias("item"), (c % 3).alias("level"), *[pick(F.floor(k / i) + c, _RESULTS).alias(f"result_{i}") for i in range(1, 9)]
    )
    return status.stage_plan(docs).withColumn("ord", F.col("ord").cast("long"))
