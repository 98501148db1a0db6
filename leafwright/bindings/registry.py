"""Registry of the queries over the given tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafwright.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can say the same."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# SQL for the tag events of every page, in the shape of ``sources.html.shred_html``.
_PIECE = r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>"'']+|"[^"]*"|''[^'']*'')*)>([^<]*)"""
TAGS = rf"""
pieces AS (
  SELECT page_id, url, unnest(p) AS piece, generate_subscripts(p, 1) AS ord FROM (
    SELECT page_id, url, regexp_extract_all(
      regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'),
        '(?is)(<script\b[^<>]*>).*?(?:</script>|\z)', '\1</script>', 'g'),
        '(?is)(<style\b[^<>]*>).*?(?:</style>|\z)', '\1</style>', 'g'),
      '{_PIECE}', 0) AS p FROM pages)),
tags AS (
  SELECT page_id, url, ord::BIGINT AS ord, regexp_extract(piece, '{_PIECE}', 1) = '/' AS closing,
    lower(regexp_extract(piece, '{_PIECE}', 2)) AS tag, regexp_extract(piece, '{_PIECE}', 3) AS attrs,
    regexp_extract(piece, '{_PIECE}', 4) AS text
  FROM pieces)
"""
HREF = """(?i)(?:^|\\s)href\\s*=\\s*"([^"]*)\""""
SPACE = (
    r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def words_sql(column: str) -> str:
    """SQL for the visible words of a column."""
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"
