"""Before/after comparison: multisets, geometry, first text difference, ink, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import visible_words
from leafwright.operators.sequence import BLOCK, running_sum, scan

MAX_RENDER_PIXELS = 20_000_000
INK_THRESHOLD = 200
RASTER_TOLERANCE = 0.15
EXCERPT = 40
SPAN = 4096  # characters compared in one row
CHUNK = 64  # characters compared one by one
MARGIN = EXCERPT + 1  # characters a span has of its neighbours


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: surplus before (``missing``) and surplus after (``added``), with multiplicity."""
    left = before.groupBy(*keys).agg(F.count("*").alias("__l"))
    right = after.groupBy(*keys).agg(F.count("*").alias("__r"))
    both = left.join(right, keys, "full")
    gap = F.coalesce("__l", F.lit(0)) - F.coalesce("__r", F.lit(0))
    return both.select(
        *keys,
        F.greatest(gap, F.lit(0)).alias("missing"),
        F.greatest(-gap, F.lit(0)).alias("added"),
    ).filter((F.col("missing") > 0) | (F.col("added") > 0))


def link_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """FIDELITY004 for links lost, FIDELITY006 for links added."""
    diff = multiset_diff(before, after, ["doc_id", "uri"])
    rule = F.when(F.col("missing") > 0, "FIDELITY004").otherwise("FIDELITY006")
    return diff.select("doc_id", "uri", rule.alias("rule_id"), (F.col("missing") + F.col("added")).alias("n"))


def regressions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Violations an edit introduced, with how many more there are of each."""
    surplus = multiset_diff(before, after, keys).filter(F.col("added") > 0)
    return surplus.select(*keys, F.col("added").cast("long").alias("surplus"))


def geometry_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """FIDELITY001 where page counts differ, else FIDELITY002 with the number of resized pages."""
    key = ["doc_id", "page"]
    left = before.select(*key, F.struct("width", "height").alias("__l"))
    right = after.select(*key, F.struct("width", "height").alias("__r"))
    both = left.join(right, key, "full")
    agg = both.groupBy("doc_id").agg(
        F.count("__l").alias("source_pages"),
        F.count("__r").alias("candidate_pages"),
        F.count_if(~F.col("__l").eqNullSafe(F.col("__r"))).alias("resized"),
    )
    rule = F.when(F.col("source_pages") != F.col("candidate_pages"), "FIDELITY001").when(
        F.col("resized") > 0, "FIDELITY002"
    )
    return agg.withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())


def numbered_pages(pages: DataFrame, block=BLOCK) -> DataFrame:
    """Each page's clean text with the characters before it in its document: doc_id, clean, n, offset.

    ``pages``: doc_id, page (long), text.  A text is moved once, to its block of pages; no document is assembled,
    and moved page breaks do not matter.  A page that says something ends with one space, so ``n`` counts that too.
    """
    clean = pages.select("doc_id", "page", visible_words(F.col("text")).alias("__c"))
    counted = clean.withColumn("clean", F.when(F.col("__c") != "", F.concat("__c", F.lit(" "))).otherwise("")).drop("__c")
    counted = counted.withColumn("n", F.char_length("clean").cast("long"))
    return scan(counted, ["doc_id"], "page", {"offset": running_sum(F.col("n"), False)}, block).select("doc_id", "clean", "n", "offset")


def _pieces(numbered: DataFrame) -> DataFrame:
    """The parts of the texts by aligned spans of ``SPAN`` characters: doc_id, span, start, text.

    A span also has the ``MARGIN`` characters on either side of it.  A page is cut once, in its own row.
    """
    rest = F.pmod(F.lit(SPAN) - F.pmod("offset", F.lit(SPAN)), F.lit(SPAN)).cast("int")
    head = F.least(rest, F.col("n").cast("int"))
    cut = numbered.filter("n > 0").withColumn("__head", head)
    whole = F.regexp_extract_all(F.substr("clean", F.col("__head") + 1), F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0))
    first = F.when(F.col("__head") > 0, F.array(F.substr("clean", F.lit(1), F.col("__head")))).otherwise(F.array().cast("array<string>"))
    parts = cut.select("doc_id", "offset", "__head", F.posexplode(F.concat(first, whole)).alias("__i", "text"))
    later = F.when((F.col("__head") > 0) & (F.col("__i") > 0), F.col("__head") + (F.col("__i") - 1).cast("long") * SPAN)
    parts = parts.withColumn("start", F.col("offset") + F.coalesce(later, F.col("__i").cast("long") * SPAN))
    parts = parts.withColumn("span", F.floor(F.col("start") / SPAN)).withColumn("__n", F.char_length("text"))
    part = lambda span, start, text: F.struct(span.alias("span"), start.alias("start"), text.alias("text"))
    low, high = F.col("span") * SPAN, (F.col("span") + 1) * SPAN
    begins = (low + MARGIN - F.col("start")).cast("int")  # what the span before it sees
    ends = F.greatest(F.lit(0), high - MARGIN - F.col("start")).cast("int")  # where the span after it begins to see
    seen = F.array_compact(
        F.array(
            part(F.col("span"), F.col("start"), F.col("text")),
            F.when((F.col("span") > 0) & (begins > 0), part(F.col("span") - 1, F.col("start"), F.substr("text", F.lit(1), begins))),
            F.when(F.col("__n") > ends, part(F.col("span") + 1, F.col("start") + ends, F.substr("text", ends + 1))),
        )
    )
    return parts.select("doc_id", F.inline(seen))


def _common_prefix(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(pairs, F.lit(False))
    return F.when(miss == 0, F.size(pairs)).otherwise(miss - 1)


def first_diff(before: DataFrame, after: DataFrame, block=BLOCK) -> DataFrame:
    """FIDELITY003: character position of the first difference in the normalised text.

    If one text is a prefix of the other the position is the shorter length.  Both texts meet span by span, a
    bounded row each, and from there on only a position and its excerpts are moved.  The excerpts hold up to 40
    characters on either side.
    """
    sides = _pieces(numbered_pages(before, block)).withColumn("side", F.lit("a")).unionByName(
        _pieces(numbered_pages(after, block)).withColumn("side", F.lit("b"))
    )
    found = []
    for side in ("a", "b"):
        own = F.col("side") == side
        found.append(F.collect_list(F.when(own, F.struct("start", "text"))).alias(side))
        found.append(F.max(F.when(own, F.col("start") + F.char_length("text"))).alias(f"end_{side}"))
    spans = sides.groupBy("doc_id", "span").agg(*found)
    low = F.greatest(F.col("span") * SPAN - MARGIN, F.lit(0))  # all texts of a span begin here, or after their end
    spans = spans.withColumn("low", low).withColumn("lead", (F.col("span") * SPAN - low).cast("int"))
    for side in ("a", "b"):
        spans = spans.withColumn(side, F.array_join(F.transform(F.sort_array(side), lambda p: p["text"]), ""))
    inside = {s: F.substr(s, F.col("lead") + 1, F.lit(SPAN)) for s in ("a", "b")}
    spans = spans.withColumn("differ", inside["a"] != inside["b"])
    # the first unlike chunk, then its first unlike character
    cut = lambda side: F.when(F.col("differ"), F.regexp_extract_all(inside[side], F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    spans = spans.withColumn("__a", cut("a")).withColumn("__b", cut("b"))
    same = F.zip_with("__a", "__b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    spans = spans.withColumn("__i", (F.array_position(same, F.lit(False)) - 1).cast("int"))
    chunk = lambda side: F.coalesce(F.get(side, F.col("__i")), F.lit(""))
    spans = spans.withColumn("__p", F.when(F.col("differ"), F.col("lead") + F.col("__i") * CHUNK + _common_prefix(chunk("__a"), chunk("__b"))))
    excerpt = lambda side: F.substr(side, F.greatest(F.col("__p") - MARGIN, F.lit(0)) + 1, F.least(F.col("__p"), F.lit(MARGIN)) + EXCERPT).alias(side)
    spot = F.when(F.col("differ"), F.struct((F.col("low") + F.col("__p")).alias("position"), excerpt("a"), excerpt("b")))
    docs = spans.select("doc_id", "end_a", "end_b", spot.alias("spot")).groupBy("doc_id").agg(
        F.min("spot").alias("spot"), *[F.greatest(F.max(f"end_{s}") - 1, F.lit(0)).alias(f"len_{s}") for s in ("a", "b")]
    )
    docs = docs.filter("spot IS NOT NULL").select("doc_id", "spot.*", *[F.coalesce(f"len_{s}", F.lit(0)).alias(f"len_{s}") for s in ("a", "b")])
    # The space that ends the last page is no part of the text: the position may move back by that one.
    at = F.least("position", "len_a", "len_b")
    have = F.greatest(F.col("position") - MARGIN, F.lit(0))  # where the excerpts begin
    low = F.greatest(at - EXCERPT, F.lit(0))
    bounded = lambda side: F.substr(
        side, (low - have + 1).cast("int"), F.greatest(F.least(at + EXCERPT, F.col(f"len_{side}")) - low, F.lit(0)).cast("int")
    )
    return docs.select("doc_id", at.cast("long").alias("position"), bounded("a").alias("source"), bounded("b").alias("candidate"))


def ink_counts(left: Column, right: Column, threshold: int = INK_THRESHOLD) -> Column:
    """Struct of moved, left and right ink pixels of one tile."""
    ink = lambda c: F.when(c < threshold, 1).otherwise(0)
    moved = F.aggregate(
        F.zip_with(left, right, lambda a, b: F.when(ink(a) != ink(b), 1).otherwise(0)),
        F.lit(0),
        lambda acc, v: acc + v,
    )
    total = lambda c: F.size(F.filter(c, lambda v: v < threshold))
    return F.struct(moved.alias("moved"), total(left).alias("left"), total(right).alias("right"))


def ink_diff(tiles: DataFrame, threshold: int = INK_THRESHOLD, tolerance: float = RASTER_TOLERANCE):
    """FIDELITY005: changed-ink ratio per page against the tolerance.

    ``tiles``: doc_id, page, left, right (luminance arrays of one tile).  A page's tiles may lie
    on different machines; only three counters per tile are shuffled.
    """
    counted = tiles.withColumn("__c", ink_counts(F.col("left"), F.col("right"), threshold))
    agg = counted.groupBy("doc_id", "page").agg(
        F.sum("__c.moved").alias("moved"),
        F.sum("__c.left").alias("__l"),
        F.sum("__c.right").alias("__r"),
    )
    ratio = F.col("moved") / F.greatest("__l", "__r", F.lit(1))
    return agg.select(
        "doc_id",
        "page",
        "moved",
        F.round(ratio, 6).alias("changed_ratio"),
        F.when(ratio > tolerance, "FIDELITY005").alias("rule_id"),
    )


def oversize(pages: DataFrame, limit: int = MAX_RENDER_PIXELS) -> DataFrame:
    """FIDELITY007: pages too large to compare pixel by pixel."""
    return pages.filter(F.col("width").cast("long") * F.col("height").cast("long") > limit)


def verify_manifest(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing, modified, unlisted and unsafe names of a bundle."""
    from leafwright.functions.names import unsafe_reason

    key = ["bundle_id", "name"]
    left = recorded.groupBy(*key).agg(
        F.min("sha256").alias("recorded"), F.count("*").alias("__n")
    )
    right = observed.groupBy(*key).agg(
        F.min("sha256").alias("observed"), F.max("kind").alias("kind")
    )
    both = left.join(right, key, "full")
    problem = (
        F.when(unsafe_reason(F.col("name")).isNotNull() | (F.col("kind") != "file"), "Unsafe")
        .when(F.col("__n") > 1, "Repeated")
        .when(F.col("observed").isNull(), "Missing")
        .when(F.col("recorded").isNull(), "Unlisted")
        .when(F.col("recorded") != F.col("observed"), "Modified")
    )
    return both.select(*key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def opaque_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose untouched members differ in any digest (as multisets)."""
    diff = multiset_diff(before, after, ["doc_id", "name", "sha256"])
    return diff.groupBy("doc_id").agg(
        F.sum("missing").alias("lost"), F.sum("added").alias("gained")
    )
