"""Text expressions: visible words, typed cues, addresses, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character Unicode treats as white space or as a separator control.
SPACE = (
    r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The patterns that decide whether a text is reported.
MANUAL_NUMBER = r"^\s*+([0-9]++(?:\.[0-9]++)*+)([.)])?\s+"
TYPED_MARKER = r"^\s*(?:[•◦▪‣*-]|\(?[0-9]{1,3}[.)]|[A-Za-z][.)])\s+\S"
# A mail address starts where its first run does or where the last match ended, so a long run without
# "@" is looked at once.
ADDRESS = (
    r"(?i)(?:https?://[^\s<>]+)"
    r"|(?:(?:\G|(?<![A-Z0-9._%+-]))[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,})"
)
RAW_ADDRESS = r"^(?i)(?:[a-z][a-z0-9+.-]*://|www\.|mailto:)\S+$"
CREDENTIALS = (
    r"(?i)(?:password|passwd|pwd|user|username|token|secret)\s*[=:]|://[^/\s]+@"
)
MAX_SIMPLE_NUMBER_DIGITS = 2  # a bare number up to 99 counts as a heading number

# Setting names that hold authentication data.
SENSITIVE_NAMES = [
    "password", "passwd", "pwd", "user", "username", "auth", "authorization", "authentication",
    "authtoken", "authenticationtoken", "accesstoken", "refreshtoken", "bearertoken", "token",
    "secret", "clientsecret", "apikey",
]


def visible_words(text: Column) -> Column:
    """Words separated by exactly one space; no-break spaces count as spaces."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only; the search stops at the first other character."""
    return F.coalesce(~text.rlike("[^" + SPACE[1:]), F.lit(True))


def is_manual_number(text: Column) -> Column:
    """Whether a heading starts with a number somebody typed."""
    number = F.regexp_extract(text, MANUAL_NUMBER, 1)
    mark = F.regexp_extract(text, MANUAL_NUMBER, 2)
    digits = F.length(F.regexp_replace(number, "^0+", ""))
    return (number != "") & (
        number.contains(".") | (mark != "") | (digits <= MAX_SIMPLE_NUMBER_DIGITS)
    )


def typed_marker(text: Column) -> Column:
    """Whether a line starts with a typed bullet, number or letter mark."""
    return text.rlike(TYPED_MARKER)


def addresses(text: Column) -> Column:
    """Every web or mail address of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0))


def split_trailing(raw: Column) -> Column:
    """Detach sentence punctuation from an address as ``struct(token, suffix)``.

    Stops ``. , ; :`` always and a closing bracket only while the token has more closing than
    opening brackets of its kind.  Folds over the trailing punctuation run only.
    """
    run = F.regexp_extract(raw, r"[.,;:)\]}]+$", 0)
    state = F.struct(raw.alias("token"), F.lit(False).alias("done"))

    def step(acc: Column, mark: Column) -> Column:
        token = acc["token"]

        def more(close: str, open_: str) -> Column:
            drop_close = F.length(F.replace(token, F.lit(close), F.lit("")))
            drop_open = F.length(F.replace(token, F.lit(open_), F.lit("")))
            return drop_close < drop_open

        strip = (
            F.when(mark == ")", more(")", "("))
            .when(mark == "]", more("]", "["))
            .when(mark == "}", more("}", "{"))
            .otherwise(F.lit(True))
        )
        keep = acc["done"] | ~strip
        shorter = F.left(token, F.length(token) - F.lit(1))
        return F.struct(
            F.when(keep, token).otherwise(shorter).alias("token"), keep.alias("done")
        )

    marks = F.reverse(F.filter(F.split(run, ""), lambda c: c != ""))
    token = F.aggregate(marks, state, step)["token"]
    return F.struct(
        token.alias("token"), F.substr(raw, F.length(token) + F.lit(1)).alias("suffix")
    )


def linkify(df: DataFrame, text: str) -> DataFrame:
    """Split a text into ordered ``(segment, words, href)`` rows without losing a character.

    The text is cut at its addresses, and the pieces between them and the addresses take turns.
    """
    source = F.col(text)
    turns = F.zip_with(F.split(source, ADDRESS, -1), addresses(source), lambda between, found: F.array(between, found))
    pieces = F.flatten(turns)
    # Odd pieces are addresses.  Each becomes its token, and its suffix joins the next text.
    rows = df.select("*", F.posexplode(pieces).alias("__i", "__piece"))
    parts = rows.withColumn(
        "__parts",
        F.when(
            F.col("__i") % 2 == 1,
            F.array(
                F.struct(
                    split_trailing(F.col("__piece"))["token"].alias("words"),
                    F.lit(True).alias("linked"),
                ),
                F.struct(
                    split_trailing(F.col("__piece"))["suffix"].alias("words"),
                    F.lit(False).alias("linked"),
                ),
            ),
        ).otherwise(F.array(F.struct(F.col("__piece").alias("words"), F.lit(False).alias("linked")))),
    )
    kept = [c for c in df.columns if c != text]
    exploded = parts.select(
        *kept, "__i", F.posexplode("__parts").alias("__j", "__part")
    ).filter(F.length("__part.words") > 0)
    words = F.col("__part.words")
    href = F.when(
        F.col("__part.linked"),
        F.when(words.rlike("(?i)^https?://"), words).otherwise(F.concat(F.lit("mailto:"), words)),
    )
    return exploded.select(
        *kept,
        (F.col("__i") * 2 + F.col("__j")).cast("long").alias("segment"),
        words.alias("words"),
        href.alias("href"),
    )


def raw_link_text(text: Column, title: Column) -> Column:
    """A link whose whole text is an address and that has no title."""
    return visible_words(text).rlike(RAW_ADDRESS) & is_blank(title)


def has_credentials(text: Column) -> Column:
    """Whether a text names a secret or carries user data in an address."""
    return text.rlike(CREDENTIALS)


def setting_identity(name: Column) -> Column:
    """A setting name reduced to lower-case letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def sensitive_setting(name: Column, kind: Column, value: Column) -> Column:
    """A non-boolean, non-blank setting whose name is on the authentication list."""
    return (
        F.coalesce(kind != "boolean", F.lit(True))
        & setting_identity(name).isin(SENSITIVE_NAMES)
        & ~is_blank(value)
    )
