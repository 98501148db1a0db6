"""HTML pages as tag events, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.nesting import match, match_in_order

# What counts as one tag, and the elements that never open a level because they are
# void or are commonly left unclosed.  A tag ends at the next "<" at the latest; nothing is taken back
# (possessive marks), so a page of any length takes linear time and no stack.
PIECE = r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>([^<]*+)"""
FLAT = """
area base br col embed hr img input link meta source track wbr
p b i em strong span u s small font option dt dd
""".split()


def cleaned(html: Column) -> Column:
    """A page without comments and without the bodies of scripts and styles.

    What is opened and never closed runs to the end of the page, so every character is looked at once.
    """
    bare = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    bare = F.regexp_replace(bare, r"(?is)(<script\b[^<>]*+>).*?(?:</script>|\z)", "$1</script>")
    return F.regexp_replace(bare, r"(?is)(<style\b[^<>]*+>).*?(?:</style>|\z)", "$1</style>")


def shred_html(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """One row per tag event: ord, closing, tag, attrs (raw), text up to the next tag.

    A row per page fans out in place; nothing is shuffled.
    """
    pieces = F.regexp_extract_all(cleaned(F.col(html)), F.lit(PIECE), F.lit(0))
    kept = [c for c in pages.columns if c != html]
    events = pages.select(*kept, F.posexplode(pieces).alias("__i", "__piece"))
    part = lambda i: F.regexp_extract("__piece", PIECE, i)
    return events.select(
        *kept,
        (F.col("__i") + 1).cast("long").alias("ord"),
        (part(1) == "/").alias("closing"),
        F.lower(part(2)).alias("tag"),
        part(3).alias("attrs"),
        part(4).alias("text"),
    )


def attribute(attrs: Column, name: str) -> Column:
    """One attribute's value; null without the attribute."""
    pattern = rf"""(?i)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(attrs, pattern, i) for i in (1, 2, 3)])
    return F.when(attrs.rlike(pattern), value)


def _step() -> Column:
    """1 for an event that opens a level, -1 for one that closes one, else 0."""
    level = ~F.col("tag").isin(FLAT)
    return F.when(level & ~F.col("closing"), 1).when(level & F.col("closing"), -1).otherwise(0)


def with_tree(events: DataFrame, doc: str = "page_id", block: int | None = None) -> DataFrame:
    """Opening events with depth and parent.

    Depth counts the open elements that open a level.  The events of ``shred_html`` come page by page and
    are matched where they are; with ``block``, events in any arrangement are dealt by blocks first.
    """
    if block is None:
        deep = match_in_order(events, doc, "ord", "tag", _step())
    else:
        deep = match(events, doc, "ord", "tag", _step(), block)
    return deep.filter(~F.col("closing"))
