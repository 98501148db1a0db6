"""Text, address, language and identity expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.bindings.registry import HREF, TAGS, query, words_sql
from leafwright.bindings.sources import LINKS, page_links, page_tags
from leafwright.functions import identity, language, names, text, uri
from leafwright.functions.language import GRANDFATHERED
from leafwright.operators.sequence import first_list
from leafwright.session import table
from leafwright.sources.html import attribute


def pick(key, values: list[str]):
    """A column that cycles through fixed texts by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def pick_sql(key: str, values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document: doc_id, lang, pos (1-based), text."""
    docs = table(spark, sf, "documents")
    split = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return split.select("doc_id", "lang", (F.col("i") + 1).cast("long").alias("pos"), "text")


LINES = """lines AS (SELECT doc_id, lang, unnest(l) AS text, generate_subscripts(l, 1)::BIGINT AS pos FROM (
  SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"""


@query(
    "b1_visible_words",
    f"""SELECT doc_id, {words_sql("replace(text, ', ', ',' || chr(160) || ' ')")} AS words FROM documents""",
)
def b1_visible_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    spaced = F.replace("text", F.lit(", "), F.lit(",\u00a0 "))
    return docs.select("doc_id", text.visible_words(spaced).alias("words"))


@query(
    "b2_manual_number",
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || '. ' || p_name
          WHEN 1 THEN p_size || ' ' || p_name WHEN 2 THEN p_partkey || '.' || p_size || ' ' || p_name
          WHEN 3 THEN p_partkey || ' ' || p_name ELSE p_name END AS text FROM part),
        m AS (SELECT *, regexp_extract(text, '^\s*([0-9]+(?:\.[0-9]+)*)([.)])?\s+', 1) AS num,
          regexp_extract(text, '^\s*([0-9]+(?:\.[0-9]+)*)([.)])?\s+', 2) AS mark FROM t)
        SELECT p_partkey, text, num <> '' AND (contains(num, '.') OR mark <> ''
          OR TRY_CAST(num AS BIGINT) <= 99) AS manual FROM m""",
)
def b2_manual_number(spark: SparkSession, sf: str) -> DataFrame:
    key, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    label = (
        F.when(key % 5 == 0, F.concat(size, F.lit(". "), name))
        .when(key % 5 == 1, F.concat(size, F.lit(" "), name))
        .when(key % 5 == 2, F.concat(key.cast("string"), F.lit("."), size, F.lit(" "), name))
        .when(key % 5 == 3, F.concat(key.cast("string"), F.lit(" "), name))
        .otherwise(name)
    )
    parts = table(spark, sf, "part").select("p_partkey", label.alias("text"))
    return parts.withColumn("manual", text.is_manual_number(F.col("text")))


@query(
    "b3_typed_marker",
    rf"""WITH {LINES} SELECT doc_id, pos FROM lines
         WHERE regexp_matches(text, '^\s*(?:[•◦▪‣*-]|\(?[0-9]{{1,3}}[.)]|[A-Za-z][.)])\s+\S')""",
)
def b3_typed_marker(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).filter(text.typed_marker(F.col("text"))).select("doc_id", "pos")


INJECTED = """prose AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' see (https://ex.org/a(b).),;'
    || ' or HTTP://x.de/[1]]} and a.b@c.de.' ELSE '' END AS text FROM documents)"""
ADDR = r"(?i)(?:https?://[^\s<>]+)|(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})"
ADDRESSES = f"""{INJECTED},
raw AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1)::BIGINT AS n FROM (
  SELECT doc_id, regexp_extract_all(text, '{ADDR}') AS a FROM prose))"""


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, every third with addresses in brackets appended."""
    extra = " see (https://ex.org/a(b).),; or HTTP://x.de/[1]]} and a.b@c.de."
    docs = table(spark, sf, "documents")
    added = F.when(F.col("doc_id") % 3 == 0, extra).otherwise("")
    return docs.select("doc_id", F.concat("text", added).alias("text"))


def address_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = prose(spark, sf).select("doc_id", F.posexplode(text.addresses(F.col("text"))).alias("i", "raw"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), "raw")


@query("b4_addresses", f"WITH {ADDRESSES} SELECT doc_id, n, raw FROM raw")
def b4_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return address_rows(spark, sf)


TRIM = """RECURSIVE {source},
step AS (SELECT {key}, raw, raw AS token FROM raw
  UNION ALL SELECT {key}, raw, left(token, length(token) - 1) FROM step WHERE length(token) > 0 AND (
    right(token, 1) IN ('.', ',', ';', ':')
    OR (right(token, 1) = ')' AND length(replace(token, ')', '')) < length(replace(token, '(', '')))
    OR (right(token, 1) = ']' AND length(replace(token, ']', '')) < length(replace(token, '[', '')))
    OR (right(token, 1) = '}}' AND length(replace(token, '}}', '')) < length(replace(token, '{{', ''))))),
cut AS (SELECT {key}, raw, arg_min(token, length(token)) AS token FROM step GROUP BY {key}, raw)"""
URLS = """raw AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '(' || url || ').,' WHEN 1 THEN url || '(a)[b]}];'
  WHEN 2 THEN url || '...' ELSE url END AS raw FROM pages)"""


@query(
    "b5_split_trailing",
    "WITH "
    + TRIM.format(source=URLS, key="page_id")
    + " SELECT page_id, token, substr(raw, length(token) + 1) AS suffix FROM cut",
)
def b5_split_trailing(spark: SparkSession, sf: str) -> DataFrame:
    url, key = F.col("url"), F.col("page_id")
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit("("), url, F.lit(").,")))
        .when(key % 4 == 1, F.concat(url, F.lit("(a)[b]}];")))
        .when(key % 4 == 2, F.concat(url, F.lit("...")))
        .otherwise(url)
    )
    return table(spark, sf, "pages").select("page_id", text.split_trailing(raw).alias("s")).select(
        "page_id", "s.token", "s.suffix"
    )


@query(
    "b6_linkify",
    "WITH "
    + TRIM.format(source=ADDRESSES, key="doc_id, n")
    + f""", fenced AS (SELECT doc_id, string_split_regex(regexp_replace(text, '({ADDR})',
           chr(57344) || '\\1' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']') AS p FROM prose),
       pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1)::BIGINT - 1 AS i FROM fenced),
       parts AS (SELECT doc_id, i * 2 AS segment, piece AS words, NULL AS href FROM pieces WHERE i % 2 = 0
         UNION ALL SELECT p.doc_id, i * 2, token,
           CASE WHEN regexp_matches(token, '(?i)^https?://') THEN token ELSE 'mailto:' || token END
           FROM pieces p JOIN cut c ON c.doc_id = p.doc_id AND c.n = (i + 1) // 2 WHERE i % 2 = 1
         UNION ALL SELECT p.doc_id, i * 2 + 1, substr(raw, length(token) + 1), NULL
           FROM pieces p JOIN cut c ON c.doc_id = p.doc_id AND c.n = (i + 1) // 2 WHERE i % 2 = 1)
       SELECT * FROM parts WHERE length(words) > 0""",
)
def b6_linkify(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as text and link segments; joined in order they give the text back."""
    return text.linkify(prose(spark, sf), "text")


@query(
    "b7_raw_link_text",
    f"""WITH {LINKS}, l AS (SELECT *, CASE WHEN ord % 5 = 0 THEN 'www.' || text ELSE text END AS label,
          CASE WHEN ord % 10 = 0 THEN 'About' ELSE '' END AS title FROM links)
        SELECT page_id, ord, label FROM l WHERE title = ''
          AND regexp_full_match({words_sql('label')}, '(?i)(?:[a-z][a-z0-9+.-]*://|www\\.|mailto:)\\S+')""",
)
def b7_raw_link_text(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("www."), "text")).otherwise(F.col("text"))
    title = F.when(F.col("ord") % 10 == 0, "About").otherwise("")
    links = page_links(spark, sf).withColumn("label", label)
    return links.filter(text.raw_link_text(F.col("label"), title)).select("page_id", "ord", "label")


@query(
    "b8_name_quality",
    f"""WITH n AS (SELECT 'c' || c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Sheet ' || c_custkey
           WHEN 1 THEN ' sheet' || c_custkey || ' ' WHEN 2 THEN '  ' ELSE c_name END AS name FROM customer
         UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Sheet ' || s_suppkey
           WHEN 1 THEN ' sheet' || s_suppkey || ' ' WHEN 2 THEN '  ' ELSE s_name END FROM supplier)
        SELECT id, name, CASE WHEN {words_sql('name')} = '' THEN 'SHEET001'
          WHEN regexp_full_match({words_sql('name')}, '(?i)sheet\\s*[0-9]+') THEN 'SHEET002' END AS rule_id
        FROM n""",
)
def b8_name_quality(spark: SparkSession, sf: str) -> DataFrame:
    def named(rows: DataFrame, prefix: str, key: str, name: str) -> DataFrame:
        k = F.col(key)
        label = (
            F.when(k % 4 == 0, F.concat(F.lit("Sheet "), k))
            .when(k % 4 == 1, F.concat(F.lit(" sheet"), k, F.lit(" ")))
            .when(k % 4 == 2, "  ")
            .otherwise(F.col(name))
        )
        return rows.select(F.concat(F.lit(prefix), k).alias("id"), label.alias("name"))

    both = named(table(spark, sf, "customer"), "c", "c_custkey", "c_name").unionByName(
        named(table(spark, sf, "supplier"), "s", "s_suppkey", "s_name")
    )
    return both.withColumn("rule_id", names.name_rule(F.col("name")))


_SHEETS = ["", "  ", "a[1]", "x/y", "'quoted", "quoted'", "plain", "q?", "a'b"]


@query(
    "b9_name_problem",
    rf"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name
           ELSE {pick_sql("p_partkey", _SHEETS)} END AS name FROM part)
         SELECT p_partkey, name, CASE WHEN trim(name) = '' THEN 'empty'
           WHEN regexp_matches(name, '[\[\]*?:/\\]') THEN 'forbidden character'
           WHEN starts_with(name, '''') OR ends_with(name, '''') THEN 'edge apostrophe' END AS problem FROM n""",
)
def b9_name_problem(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 2 == 0, F.col("p_name")).otherwise(pick(key, _SHEETS))
    parts = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return parts.withColumn("problem", names.name_problem(F.col("name")))


_TAG_TAILS = [
    "", "_us", "-hant-tw", "-rozaj-biske-rozaj", "-a-bbb-x-a-ccc", "-a-bbb-a-ccc", "-1994-1996-x-y",
    "-toolongvariant", "-419", "--", "-LATN_us-oxendict", "-x",
]
_TAG_WHOLE = ["I-KLINGON", "x-Private-Use", "", "  ", "zh_min_nan", "not a tag", "en-gb-OED", "1234"]
_WHOLE_SQL = ", ".join(f"('{t.lower()}', '{t}')" for t in GRANDFATHERED)
# Subtags in order: language, script, region, variants, extensions, private use.
TAG = (
    "^([A-Za-z]{2,3}(?:-[A-Za-z]{3}){0,3}|[A-Za-z]{4,8})(-[A-Za-z]{4})?(-(?:[A-Za-z]{2}|[0-9]{3}))?"
    "((?:-(?:[A-Za-z0-9]{5,8}|[0-9][A-Za-z0-9]{3}))*)((?:-[0-9A-WYZa-wyz](?:-[A-Za-z0-9]{2,8})+)*)"
    "(-x(?:-[A-Za-z0-9]{1,8})+)?$"
)
TAGGED = f"""t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN {pick_sql("doc_id // 3", _TAG_WHOLE)}
    ELSE lang || {pick_sql("doc_id", _TAG_TAILS)} END AS raw FROM documents)"""
NORMAL = f"""v AS (SELECT *, replace(trim(raw), '_', '-') AS v FROM t),
whole(k, w) AS (VALUES {_WHOLE_SQL}),
g AS (SELECT v.*, w, regexp_matches(v, '(?i)^x(?:-[A-Za-z0-9]{{1,8}})+$') AS private,
  regexp_matches(v, '{TAG}') AS ok, regexp_extract(v, '{TAG}', 1) AS g1, regexp_extract(v, '{TAG}', 2) AS g2,
  regexp_extract(v, '{TAG}', 3) AS g3, regexp_extract(v, '{TAG}', 4) AS g4,
  regexp_extract(v, '{TAG}', 5) AS g5, regexp_extract(v, '{TAG}', 6) AS g6
  FROM v LEFT JOIN whole ON k = lower(v)),
h AS (SELECT *, list_filter(string_split(lower(g4), '-'), lambda x: x <> '') AS vars,
  list_filter(string_split(lower(g5), '-'), lambda x: length(x) = 1) AS singles FROM g),
r AS (SELECT *, len(list_distinct(vars)) <> len(vars) OR len(list_distinct(singles)) <> len(singles)
  AS repeated FROM h),
normal AS (SELECT *, CASE WHEN v = '' THEN NULL WHEN w IS NOT NULL THEN w WHEN private THEN lower(v)
    WHEN NOT ok OR repeated THEN NULL
    ELSE lower(g1) || lower(g2[1:1]) || upper(g2[2:2]) || lower(g2[3:]) || upper(g3) || lower(g4)
      || lower(g5) || lower(g6) END AS tag,
  CASE WHEN v = '' OR w IS NOT NULL OR private THEN NULL WHEN NOT ok THEN 'malformed'
    WHEN repeated THEN 'repeated' END AS problem FROM r)"""


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    raw = F.when(key % 3 == 2, pick(F.floor(key / 3), _TAG_WHOLE)).otherwise(
        F.concat("lang", pick(key, _TAG_TAILS))
    )
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


@query("b10_normalize_language", f"WITH {TAGGED}, {NORMAL} SELECT doc_id, raw, tag, problem FROM normal")
def b10_normalize_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagged(spark, sf).withColumn("n", language.normalize_language(F.col("raw")))
    return rows.select("doc_id", "raw", "n.tag", "n.problem")


@query(
    "b11_language_parts",
    f"""WITH {TAGGED}, {NORMAL}, s AS (SELECT doc_id, tag, w IS NULL AND regexp_matches(tag, '{TAG}')
           AND NOT contains(regexp_extract(tag, '{TAG}', 1), '-') AND regexp_extract(tag, '{TAG}', 4)
           || regexp_extract(tag, '{TAG}', 5) || regexp_extract(tag, '{TAG}', 6) = '' AS simple
         FROM normal WHERE tag IS NOT NULL)
        SELECT doc_id, tag, CASE WHEN simple THEN regexp_extract(tag, '{TAG}', 1) END AS language,
          CASE WHEN simple THEN nullif(substr(regexp_extract(tag, '{TAG}', 2), 2), '') END AS script,
          CASE WHEN simple THEN nullif(substr(regexp_extract(tag, '{TAG}', 3), 2), '') END AS region,
          CASE WHEN NOT simple THEN tag END AS "full" FROM s""",
)
def b11_language_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagged(spark, sf).select("doc_id", language.normalize_language(F.col("raw"))["tag"].alias("tag"))
    return rows.filter("tag IS NOT NULL").select(
        "doc_id", "tag", language.language_parts(F.col("tag")).alias("p")
    ).select("doc_id", "tag", "p.*")


_REFS = [
    "{t}", "../x/./{t}", "?q={t}", "#frag", "", "//host.example/a//{t}/../b", "a//b/{t}", "http://h/{t}?#",
    "a b", "%zz", "x:y", "./..", "1:2", "{t}?", "{t}#", "../../../../{t}/",
]
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_UNIT = r"\w.~!$&''()*+,;=-"
_HEX = "%[0-9A-Fa-f][0-9A-Fa-f]"
_AUTHORITY = rf"^(?:(?:[:{_UNIT}]|{_HEX})*@)?(?:(?:[{_UNIT}]|{_HEX})*|\[[:{_UNIT}]+\])(?::[0-9]*)?$"
REFERENCES = f"""{LINKS},
refs AS (SELECT page_id, ord, url AS base, replace({pick_sql("ord", _REFS)}, '{{t}}', substr(href, 2)) AS href FROM links)"""


@query(
    "b12_resolve_uri",
    rf"""WITH {REFERENCES},
    p AS (SELECT *, regexp_extract(href, '{_SPLIT}', 1) AS rs, regexp_extract(href, '{_SPLIT}', 2) AS ra,
      regexp_extract(href, '{_SPLIT}', 3) AS rp, regexp_extract(href, '{_SPLIT}', 4) AS rq,
      regexp_extract(href, '{_SPLIT}', 5) AS rf, regexp_extract(base, '{_SPLIT}', 1) AS bs,
      regexp_extract(base, '{_SPLIT}', 2) AS ba, regexp_extract(base, '{_SPLIT}', 3) AS bp,
      regexp_extract(base, '{_SPLIT}', 4) AS bq,
      regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AS has_a,
      regexp_matches(href, '^[^#]*\?') AS has_q, regexp_matches(base, '^[^#]*\?') AS base_q FROM refs),
    q AS (SELECT *, CASE WHEN regexp_matches(href, '[\x00-\x20]') THEN 'characters'
        WHEN NOT (regexp_matches(ra, '{_AUTHORITY}') AND regexp_matches(rp, '^(?:[:@/{_UNIT}]|{_HEX})*$')
          AND regexp_matches(rq, '^(?:[:@/?{_UNIT}]|{_HEX})*$') AND regexp_matches(rf, '^(?:[:@/?{_UNIT}]|{_HEX})*$')) THEN 'components'
        WHEN rs = '' AND contains(string_split(rp, '/')[1], ':') THEN 'relative' END AS problem,
      CASE WHEN has_a THEN rp WHEN rp = '' THEN bp WHEN starts_with(rp, '/') THEN rp
        ELSE CASE WHEN regexp_replace(bp, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(bp, '[^/]*$', '') END
          || rp END AS path, (has_a AND rp <> '') OR (NOT has_a AND rp <> '') AS dots FROM p),
    d AS (SELECT *, CASE WHEN NOT dots THEN path ELSE
        array_to_string(list_reduce(list_transform(string_split(path, '/'), lambda s: [s]),
          lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN
            CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END ELSE list_concat(a, s) END), '/')
        || CASE WHEN list_extract(string_split(path, '/'), -1) IN ('.', '..') THEN '/' ELSE '' END END AS clean FROM q)
    SELECT page_id, ord, problem, CASE WHEN problem IS NOT NULL THEN NULL WHEN rs <> '' THEN href ELSE
      bs || '://' || CASE WHEN has_a THEN ra ELSE ba END || clean
      || CASE WHEN has_q THEN '?' || rq WHEN NOT has_a AND rp = '' AND base_q THEN '?' || bq ELSE '' END
      || CASE WHEN contains(href, '#') THEN '#' || rf ELSE '' END END AS uri FROM d""",
)
def b12_resolve_uri(spark: SparkSession, sf: str) -> DataFrame:
    links = page_links(spark, sf)
    href = F.replace(pick(F.col("ord"), _REFS), F.lit("{t}"), F.substr("href", F.lit(2)))
    rows = links.select("page_id", "ord", uri.resolve_uri(href, F.col("url")).alias("r"))
    return rows.select("page_id", "ord", "r.uri", "r.problem")


@query(
    "b13_relative_links",
    rf"""WITH {REFERENCES} SELECT page_id, count(*) AS n FROM refs WHERE href <> '' AND NOT starts_with(href, '#')
        AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') GROUP BY 1""",
)
def b13_relative_links(spark: SparkSession, sf: str) -> DataFrame:
    href = F.replace(pick(F.col("ord"), _REFS), F.lit("{t}"), F.substr("href", F.lit(2)))
    links = page_links(spark, sf).filter(uri.is_relative_link(href))
    return links.groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    "b14_credentials",
    rf"""SELECT doc_id FROM documents WHERE regexp_matches(text, '{text.CREDENTIALS}')""",
)
def b14_credentials(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold credential-like text; the value itself is never returned."""
    return table(spark, sf, "documents").filter(text.has_credentials(F.col("text"))).select("doc_id")


_SETTINGS = ["Pass-Word", "API Key", "colour", "ACCESS_TOKEN", "user.name", "theme"]


@query(
    "b15_sensitive_setting",
    rf"""WITH s AS (SELECT user_id, {pick_sql("event_id", _SETTINGS)} AS name,
           CASE WHEN event_id % 4 = 0 THEN 'boolean' WHEN event_id % 4 = 1 THEN 'string' END AS kind,
           CASE WHEN event_id % 7 = 0 THEN ' ' ELSE json_extract_string(props, '$.k') END AS value FROM events)
         SELECT user_id AS doc_id, count(*) AS n FROM s WHERE coalesce(kind, '') <> 'boolean' AND trim(value) <> ''
           AND regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]', '', 'g') IN ({", ".join(f"'{n}'" for n in text.SENSITIVE_NAMES)})
         GROUP BY 1""",
)
def b15_sensitive_setting(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    value = F.when(key % 7 == 0, " ").otherwise(F.get_json_object("props", "$.k"))
    kind = F.when(key % 4 == 0, "boolean").when(key % 4 == 1, "string")
    hit = text.sensitive_setting(pick(key, _SETTINGS), kind, value)
    events = table(spark, sf, "events").filter(hit)
    return events.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n"))


_PATHS = [
    " see /home/ann/My Documents/f.odt: ok", " C:\\Users\\bob\\x.txt|", " ~/notes.md\n",
    " file:///srv/a/b.xml done", " \\\\host\\share\\deep\\z.doc:", " /work/in/file.txt\n", " a/b/c",
    " ../up/here.md:", " at /work/in|",
]
_SEG = r"[^/\\\s''\"<>|:]+(?: [^/\\\s''\"<>|:]+)*"
_LAST = r"([^/\\\s''\"<>|:]+(?: [^/\\\s''\"<>|:]+)*)"


@query(
    "b16_redact",
    rf"""WITH t AS (SELECT doc_id, text || {pick_sql("doc_id", _PATHS)} AS text FROM documents),
      k AS (SELECT doc_id, regexp_replace(text, '(^|[^\w.-])[\\/]work[\\/]in([^\w.-]|$)', '\1<inputs>\2', 'g') AS text FROM t)
      SELECT doc_id, regexp_replace(text,
        'file://(?:[^\s''"<>]*[/\\])?([^\s''"<>/\\]+)[/\\]*'
        || '|(^|[^\w.:/~>-])(?:~|\.\.)?/(?:{_SEG}/)+{_LAST}'
        || '|(^|[^\w.:/~>-])(?:~|\.\.)/{_LAST}'
        || '|\b[A-Za-z]:[\\/](?:{_SEG}[\\/])*{_LAST}'
        || '|\\\\[\w.$-]+\\(?:{_SEG}\\)*{_LAST}', '\2\4<path>/\1\3\5\6\7', 'g') AS text FROM k""",
)
def b16_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with known and other local paths hidden."""
    docs = table(spark, sf, "documents")
    added = F.concat("text", pick(F.col("doc_id"), _PATHS))
    return docs.select("doc_id", uri.redact(added, {"inputs": "/work/in"}).alias("text"))


_FILES = ["", "/abs", "a//b", "a/../b", "manifest.JSON", "x/con.txt", "end. ", "a:b", "lpt1", "a/b/"]


@query(
    "b17_unsafe_reason",
    rf"""WITH n AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {pick_sql("page_id // 2", _FILES)}
        WHEN page_id % 31 = 1 THEN 'a/' || repeat('é', 130) ELSE regexp_replace(url, '^https?://', '') END AS name FROM pages)
      SELECT page_id, name, CASE WHEN name = '' THEN 'empty'
        WHEN regexp_matches(name, '[\x00-\x1f\x7f\\<>:"|?*]') THEN 'forbidden character'
        WHEN starts_with(name, '/') THEN 'absolute'
        WHEN len(list_filter(string_split(name, '/'), lambda p: p IN ('', '.', '..'))) > 0 THEN 'not normalised'
        WHEN lower(name) = 'manifest.json' THEN 'reserved'
        WHEN len(list_filter(string_split(name, '/'), lambda p: regexp_full_match(p,
          '(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?') OR ends_with(p, '.') OR ends_with(p, ' '))) > 0 THEN 'not portable'
        WHEN len(list_filter(string_split(name, '/'), lambda p: strlen(p) > 255)) > 0 THEN 'too long' END AS reason FROM n""",
)
def b17_unsafe_reason(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id")
    name = (
        F.when(key % 2 == 0, pick(F.floor(key / 2), _FILES))
        .when(key % 31 == 1, F.concat(F.lit("a/"), F.repeat(F.lit("é"), 130)))
        .otherwise(F.regexp_replace("url", "^https?://", ""))
    )
    pages = table(spark, sf, "pages").select("page_id", name.alias("name"))
    return pages.withColumn("reason", names.unsafe_reason(F.col("name")))


_LABELS = [
    "content/p[1]", "{u}", "x%3D/home/ann/f", "https%3A%2F%2Fbob@h/x", "/abs/path", "a+b%2", "c=C:%5Cx",
    "%5C%5Chost", "part/%E2%82%AC",
]


@query(
    "b18_safe_label",
    rf"""WITH l AS (SELECT page_id, replace({pick_sql("page_id", _LABELS)}, '{{u}}', url) AS label FROM pages),
      d AS (SELECT *, url_decode(label) AS dec FROM l)
      SELECT page_id, label, NOT (regexp_matches(dec, '(?i)(?:[a-z][a-z0-9+.-]*://[^/\s]*@|(?:/Users/|/home/|[A-Za-z]:[\\/]))')
        OR starts_with(dec, '/') OR starts_with(dec, '\') OR regexp_matches(dec, '[=\s](?:/|[A-Za-z]:[\\/])')) AS safe FROM d""",
)
def b18_safe_label(spark: SparkSession, sf: str) -> DataFrame:
    label = F.replace(pick(F.col("page_id"), _LABELS), F.lit("{u}"), F.col("url"))
    pages = table(spark, sf, "pages").select("page_id", label.alias("label"))
    return pages.withColumn("safe", names.safe_label(F.col("label")))


@query(
    "b19_target_path",
    """WITH t AS (SELECT 'nation' AS kind, n_name || ' ~é*(/' AS name, n_nationkey::BIGINT AS n FROM nation
         UNION ALL SELECT 'region', CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE r_name END, r_regionkey FROM region
         UNION ALL SELECT 'customer', c_name, c_custkey FROM customer)
       SELECT kind, n, 'content/' || kind || CASE WHEN name <> '' THEN '[name=' || url_encode(name) || ']'
         ELSE '[' || n || ']' END AS path FROM t""",
)
def b19_target_path(spark: SparkSession, sf: str) -> DataFrame:
    def rows(frame: DataFrame, kind: str, name, key: str) -> DataFrame:
        path = identity.target_path(F.lit("content"), F.lit(kind), name, F.col(key))
        return frame.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("n"), path.alias("path"))

    odd = F.concat("n_name", F.lit(" ~é*(/"))
    some = F.when(F.col("r_regionkey") % 2 == 0, "").otherwise(F.col("r_name"))
    return (
        rows(table(spark, sf, "nation"), "nation", odd, "n_nationkey")
        .unionByName(rows(table(spark, sf, "region"), "region", some, "r_regionkey"))
        .unionByName(rows(table(spark, sf, "customer"), "customer", F.col("c_name"), "c_custkey"))
    )


@query(
    "b20_fingerprint",
    """SELECT c_custkey, substr(sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment':
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, 'c_name': c_name,
         'c_nationkey': c_nationkey})), 1, 16) AS fingerprint FROM customer""",
)
def b20_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Customer identity without the answerable balance; nulls are part of it."""
    rows = table(spark, sf, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    )
    protected = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return rows.select("c_custkey", identity.fingerprint(protected).alias("fingerprint"))


@query(
    "b21_bound_details",
    """WITH n AS (SELECT DISTINCT p_brand, repeat(p_name || ' ', 40) AS v FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS n FROM n)
       SELECT p_brand, string_agg(left(v, 200), '|' ORDER BY n) AS names FROM r WHERE n <= 8 GROUP BY 1""",
)
def b21_bound_details(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight distinct names per brand, each cut to the text limit."""
    long_ = F.repeat(F.concat("p_name", F.lit(" ")), 40)
    seen = table(spark, sf, "part").select("p_brand", long_.alias("v")).distinct()
    value = identity.bound_text(F.col("v"), 200)
    listed = first_list(seen, ["p_brand"], ["v"], value, "names", identity.DETAIL_ITEMS)
    return listed.select("p_brand", F.array_join("names", "|").alias("names"))


_RANGES = [
    "{t}.A{n}", "$'My ''T'''.$AB${n}:.C{n}0", "T.a{n}:T.zz{n}", "T.A1:U.B2", "A{n}", ".XFE{n}", ".A00{n}",
    "'x y'.B{n}:'x y'.C5", "T.A{n}:B2",
]
_TBL = r"\$?(?:''(?:[^'']|'''')+''|[^.\s:]+)"
_RNG = rf"^({_TBL})?\.\$?([A-Za-z]+)\$?([0-9]+)(?::({_TBL})?\.\$?([A-Za-z]+)\$?([0-9]+))?$"
_NUM = (
    "list_reduce(list_transform(string_split(upper({c}), ''), lambda x: ascii(x)::BIGINT - 64), "
    "lambda a, x: CASE WHEN a > 16384 THEN a ELSE a * 26 + x END)"
)


@query(
    "b22_parse_range",
    rf"""WITH a AS (SELECT p_partkey, replace(replace({pick_sql("p_partkey", _RANGES)}, '{{t}}', p_brand), '{{n}}',
         p_partkey::VARCHAR) AS address FROM part),
      g AS (SELECT *, regexp_extract(address, '{_RNG}', 1) AS t, regexp_extract(address, '{_RNG}', 2) AS c,
        regexp_extract(address, '{_RNG}', 3) AS r, regexp_extract(address, '{_RNG}', 4) AS et,
        regexp_extract(address, '{_RNG}', 5) AS ec, regexp_extract(address, '{_RNG}', 6) AS er FROM a
        WHERE regexp_matches(address, '{_RNG}')),
      n AS (SELECT *, nullif(replace(regexp_replace(regexp_replace(t, '^\$?''?', ''), '''$', ''), '''''', ''''), '') AS tn,
        nullif(replace(regexp_replace(regexp_replace(et, '^\$?''?', ''), '''$', ''), '''''', ''''), '') AS en FROM g)
      SELECT p_partkey, tn AS "table", r::BIGINT AS first_row, CASE WHEN er <> '' THEN er ELSE r END::BIGINT AS last_row,
        {_NUM.format(c="c")} AS first_column, {_NUM.format(c="CASE WHEN ec <> '' THEN ec ELSE c END")} AS last_column
      FROM n WHERE en IS NULL OR tn IS NULL OR en = tn""",
)
def b22_parse_range(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    address = F.replace(
        F.replace(pick(key, _RANGES), F.lit("{t}"), F.col("p_brand")), F.lit("{n}"), key.cast("string")
    )
    rows = table(spark, sf, "part").select("p_partkey", identity.parse_range(address).alias("r"))
    return rows.filter("r IS NOT NULL").select("p_partkey", "r.*")


@query(
    "b23_active_content",
    rf"""WITH {TAGS}, n AS (SELECT page_id, count(*) FILTER (WHERE tag IN ('script', 'foreignobject')) AS scripts,
        count(*) FILTER (WHERE regexp_matches(attrs, '(?i)(?:^|\s)on[a-z]+\s*=')) AS events,
        count(*) FILTER (WHERE regexp_extract(attrs, '{HREF}', 1) <> ''
          AND NOT starts_with(regexp_extract(attrs, '{HREF}', 1), '#')) AS external,
        count(*) FILTER (WHERE regexp_matches(attrs, '(?i)url\(\s*[^#\s]')) AS css
        FROM tags WHERE NOT closing GROUP BY 1) SELECT * FROM n""",
)
def b23_active_content(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts, event attributes, non-local references and external styles per page."""
    tags = page_tags(spark, sf).filter(~F.col("closing"))
    href = attribute(F.col("attrs"), "href")
    return tags.groupBy("page_id").agg(
        F.count_if(F.col("tag").isin("script", "foreignobject")).alias("scripts"),
        F.count_if(F.col("attrs").rlike(r"(?i)(?:^|\s)on[a-z]+\s*=")).alias("events"),
        F.count_if((href != "") & ~href.startswith("#")).alias("external"),
        F.count_if(F.col("attrs").rlike(r"(?i)url\(\s*[^#\s]")).alias("css"),
    )


@query(
    "b24_channel_tag",
    f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS l,
          CASE WHEN doc_id % 3 = 0 THEN 'Latn' WHEN doc_id % 3 = 1 THEN 'none' END AS s,
          CASE WHEN doc_id % 4 = 0 THEN 'us' END AS c,
          CASE WHEN doc_id % 7 = 0 THEN 'de_at' WHEN doc_id % 7 = 1 THEN 'NONE' WHEN doc_id % 7 = 2 THEN 'bad tag' END AS f
          FROM documents),
        t AS (SELECT doc_id, CASE WHEN f <> '' AND lower(f) <> 'none' THEN f WHEN l <> '' AND l <> 'none' THEN
          concat_ws('-', l, CASE WHEN s <> 'none' THEN s END, c) END AS raw FROM c),
        {NORMAL} SELECT doc_id, raw, tag, problem FROM normal""",
)
def b24_channel_tag(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    lang = F.when(key % 5 == 0, "none").when(key % 11 == 0, "").otherwise(F.col("lang"))
    script = F.when(key % 3 == 0, "Latn").when(key % 3 == 1, "none")
    country = F.when(key % 4 == 0, "us")
    full = F.when(key % 7 == 0, "de_at").when(key % 7 == 1, "NONE").when(key % 7 == 2, "bad tag")
    rows = table(spark, sf, "documents").select(
        "doc_id", language.channel_tag(lang, script, country, full).alias("raw")
    )
    checked = rows.withColumn("n", language.normalize_language(F.col("raw")))
    return checked.select("doc_id", "raw", "n.tag", "n.problem")
