"""Target paths, fingerprints, bounded details and cell addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETAIL_ITEMS = 8
DETAIL_CHARACTERS = 4096


def percent_encode(text: Column) -> Column:
    """RFC 3986 quoting; the JVM's form encoding differs in three characters."""
    encoded = F.url_encode(text)
    for wrong, right in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(wrong), F.lit(right))
    return encoded


def target_path(context: Column, kind: Column, name: Column, position: Column) -> Column:
    """``context/kind[name=..]`` where there is a name, else ``context/kind[n]``."""
    named = F.concat(F.lit("[name="), percent_encode(name), F.lit("]"))
    indexed = F.concat(F.lit("["), position.cast("string"), F.lit("]"))
    inner = F.when(F.coalesce(name != "", F.lit(False)), named).otherwise(indexed)
    return F.concat(context, F.lit("/"), kind, inner)


def fingerprint(columns: list[str]) -> Column:
    """The first 16 hex digits of the digest of the protected columns, nulls included."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 16)


def row_weight(content: Column) -> Column:
    """A 60-bit number from a row's digest.

    Summed as a decimal it identifies a set of rows of any size with a partial aggregate, so no
    group has to be collected to be compared.
    """
    return F.conv(F.substring(F.sha2(content, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def bound_text(text: Column, limit: int = DETAIL_CHARACTERS) -> Column:
    """A detail text cut to the presentation limit."""
    return F.left(text, F.lit(limit))


def bound_details(details: Column) -> Column:
    """A details map with every value cut to the presentation limit."""
    return F.transform_values(details, lambda _, v: bound_text(v))


# Fixed value: one cell or a range of cells; groups are table, column, row and the end's three.
_TABLE = r"\$?(?:'(?:[^']++|'')++'|[^.\s:]+)"
RANGE = (
    rf"^({_TABLE})?\.\$?([A-Za-z]+)\$?([0-9]+)"
    rf"(?::({_TABLE})?\.\$?([A-Za-z]+)\$?([0-9]+))?$"
)


def _table_name(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\$?'?", ""), "'$", "")
    return F.nullif(F.replace(bare, F.lit("''"), F.lit("'")), F.lit(""))


def column_number(letters: Column, limit: int = 16384) -> Column:
    """Column letters as a number; stops once past the grid so long input cannot overflow."""
    return F.aggregate(
        F.filter(F.split(F.upper(letters), ""), lambda c: c != ""),
        F.lit(0).cast("long"),
        lambda acc, c: F.when(acc > limit, acc).otherwise(
            acc * F.lit(26) + F.ascii(c).cast("long") - F.lit(64)
        ),
    )


def parse_range(address: Column) -> Column:
    """A cell range as a struct of table, first/last row and column; null if unsupported."""
    part = lambda i: F.regexp_extract(address, RANGE, i)
    start, end = _table_name(part(1)), _table_name(part(4))
    row = lambda text: F.try_to_number(F.regexp_replace(text, "^0+(?=.)", ""), F.lit("9" * 18)).cast(
        "long"
    )
    last_row = F.when(part(6) != "", row(part(6))).otherwise(row(part(3)))
    last_col = F.when(part(5) != "", part(5)).otherwise(part(2))
    supported = address.rlike(RANGE) & (
        end.isNull() | start.isNull() | end.eqNullSafe(start)
    )
    return F.when(
        supported,
        F.struct(
            start.alias("table"),
            row(part(3)).alias("first_row"),
            last_row.alias("last_row"),
            column_number(part(2)).alias("first_column"),
            column_number(last_col).alias("last_column"),
        ),
    )
