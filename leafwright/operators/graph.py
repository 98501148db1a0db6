"""Recursive questions as a few joins: cycles, inheritance chains, roles, reachability.

Paths are doubled, not walked: after k rounds a row holds its 2^k-th successor, so a chain of any
depth needs log2(depth) joins.  Each round is cut with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.session import Appended, cut, stored

# Structure types a role needs no mapping for.
STANDARD_ROLES = """
Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6
L LI Lbl LBody Table TR TH TD THead TBody TFoot Span Quote Note Reference BibEntry Code Link Annot
Ruby RB RT RP Warichu WT WP Figure Formula Form
""".split()
MAX_EMBEDDED = 64


def cycles(edges: DataFrame) -> DataFrame:
    """Members of cycles, not the nodes that lead into one.

    ``edges``: doc_id, node, next (one row per node).  With g the 2^k-th successor, only nodes in
    the image of g survive a round; once a round loses none, g permutes the survivors, which are
    then exactly the nodes on cycles.
    """
    key = ["doc_id", "node"]
    live = cut(edges.filter(F.col("next").isNotNull()).select("doc_id", "node", "next"))
    size = live.count()
    while size:
        image = live.select("doc_id", F.col("next").alias("node")).distinct()
        kept = live.join(image, key, "left_semi")
        jump = kept.select("doc_id", F.col("node").alias("next"), F.col("next").alias("__far"))
        doubled = cut(kept.join(jump, ["doc_id", "next"]).select(*key, F.col("__far").alias("next")))
        new = doubled.count()
        live = doubled
        if new == size:
            break
        size = new
    return live.select(*key)


def resolve_chains(
    nodes: DataFrame,
    keys: list[str],
    parent: str = "parent",
    stop: Column | None = None,
    props: str | None = None,
) -> DataFrame:
    """Follow ``parent`` (same last key, same other keys) to the root of every node.

    ``nodes`` may define a name more than once (ambiguous) or mark it ``conditional``.  The result
    has one row per name: ``root``, ``depth``, ``status`` (null, missing, ambiguous, conditional
    or cyclic, whichever comes first on the way up) and, with ``props``, the effective properties
    with a child's value over its parent's.
    """
    name, scope = keys[-1], keys[:-1]
    conditional = F.col("conditional") if "conditional" in nodes.columns else F.lit(False)
    empty = F.expr("cast(map() as map<string,string>)")
    value = F.coalesce(F.col(props), empty) if props else empty
    defined = nodes.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.bool_or(conditional).alias("__c"),
        F.min(parent).alias("__next"),
        F.any_value(value).alias("__props"),
    )
    status = F.when(F.col("__n") > 1, "ambiguous").when(F.col("__c"), "conditional")
    halted = status.isNotNull() | (stop if stop is not None else F.lit(False))
    state = cut(
        defined.select(
            *keys,
            status.alias("status"),
            F.when(~halted & (F.col("__next") != ""), F.col("__next")).alias("next"),
            F.col(name).alias("root"),
            F.lit(0).cast("long").alias("depth"),
            F.col("__props").alias("props"),
        )
    )
    active = state.filter(F.col("next").isNotNull()).count()
    while active:
        far = state.select(
            *scope,
            F.col(name).alias("next"),
            F.col("next").alias("__next"),
            F.col("status").alias("__status"),
            F.col("root").alias("__root"),
            F.col("depth").alias("__depth"),
            F.col("props").alias("__props"),
            F.lit(True).alias("__found"),
        )
        joined = state.join(far, [*scope, "next"], "left")
        moving = F.col("next").isNotNull()
        lost = moving & F.col("__found").isNull()
        over = F.map_concat(
            "props",
            F.map_filter(
                F.coalesce("__props", empty),
                lambda k, _: ~F.array_contains(F.map_keys("props"), k),
            ),
        )
        state = cut(
            joined.select(
                *keys,
                F.when(lost, "missing")
                .when(moving, F.col("__status"))
                .otherwise(F.col("status"))
                .alias("status"),
                F.when(moving & ~lost, F.col("__next")).alias("next"),
                F.when(moving & ~lost, F.col("__root")).otherwise(F.col("root")).alias("root"),
                (
                    F.col("depth")
                    + F.when(moving, F.coalesce("__depth", F.lit(0)) + 1).otherwise(0)
                ).alias("depth"),
                F.when(moving, over).otherwise(F.col("props")).alias("props"),
            )
        )
        left = state.filter(F.col("next").isNotNull()).count()
        if left == active:  # no chain ended in this doubling: only cycles are left
            break
        active = left
    cyclic = F.col("next").isNotNull()
    return state.select(
        *keys,
        F.when(cyclic, "cyclic").otherwise(F.col("status")).alias("status"),
        F.when(~cyclic, F.col("root")).alias("root"),
        F.when(~cyclic, F.col("depth")).alias("depth"),
        "props",
    )


def resolve_roles(role_map: DataFrame) -> DataFrame:
    """The standard role of every mapped custom role; none for a cycle or a dead end.

    ``role_map``: doc_id, role, mapped.
    """
    standard = F.col("role").isin(STANDARD_ROLES)
    ends = (
        role_map.select("doc_id", F.col("mapped").alias("role"), F.lit("").alias("mapped"))
        .filter(standard)
        .distinct()
    )
    known = role_map.filter(~standard).select("doc_id", "role", "mapped").unionByName(ends)
    found = resolve_chains(known, ["doc_id", "role"], "mapped")
    resolved = F.when(F.col("status").isNull() & F.col("root").isin(STANDARD_ROLES), F.col("root"))
    return found.filter(~standard).select("doc_id", "role", resolved.alias("standard_role"))


def described_graphics(figures: DataFrame, painted: DataFrame) -> DataFrame:
    """Figures with an alternative and painted content in themselves or below.

    ``figures``: doc_id, node_id, alt.  ``painted``: doc_id, node_id, ancestors (ids, itself
    included).  Ancestor arrays make this one pass: explode, reduce, semi join.
    """
    owners = painted.select("doc_id", F.explode("ancestors").alias("node_id")).distinct()
    described = figures.filter(F.coalesce(F.trim("alt") != "", F.lit(False)))
    return described.join(owners, ["doc_id", "node_id"], "left_semi")


def listed_shapes(pages: DataFrame) -> DataFrame:
    """The shape identities a page's ``nav_order`` text names, one row each."""
    ids = F.filter(F.split(F.trim("nav_order"), r"\s+"), lambda s: s != "")
    return pages.filter(F.col("nav_order").isNotNull()).select(
        "doc_id", "page_id", F.explode(ids).alias("shape_id")
    )


def navigation(pages: DataFrame, listed: DataFrame, shapes: DataFrame) -> DataFrame:
    """PAGE004 for an incomplete or ambiguous order, PAGE005 for a missing one.

    ``pages``: doc_id, page_id, declared (whether it states an order).  ``listed`` and ``shapes``:
    doc_id, page_id, shape_id (null for a shape without one).  Both are compared by counts, so no
    page collects its shapes.
    """
    key = ["doc_id", "page_id"]
    sides = listed.select(*key, "shape_id", F.lit(1).alias("l"), F.lit(0).alias("o")).unionByName(
        shapes.select(*key, "shape_id", F.lit(0).alias("l"), F.lit(1).alias("o"))
    )
    both = sides.groupBy(*key, "shape_id").agg(F.sum("l").alias("n_listed"), F.sum("o").alias("n_owned"))
    # A shape owned once by its page is owned once by its document, unless it is among the repeated ones.
    # These are written first: where they are few, nothing is moved to meet them.
    repeated = stored(
        shapes.filter("doc_id IS NOT NULL AND shape_id IS NOT NULL").groupBy("doc_id", "shape_id").agg(F.count("*").alias("n"))
        .filter("n > 1").select("doc_id", "shape_id", F.lit(True).alias("again"))
    )
    both = both.join(repeated, ["doc_id", "shape_id"], "left")
    named = F.col("shape_id").isNotNull()
    wrong = ~F.coalesce(named & (F.col("n_listed") == 1) & (F.col("n_owned") == 1) & F.col("again").isNull(), F.lit(False))
    agg = both.groupBy(*key).agg(F.bool_or(wrong).alias("wrong"), F.sum("n_owned").alias("n_shapes"))
    joined = pages.join(agg, key, "left")
    n = F.coalesce("n_shapes", F.lit(0))
    declared = F.col("declared")
    rule = F.when(declared & (F.coalesce("wrong", F.lit(True)) | (n == 0)), "PAGE004").when(
        ~declared & (n > 1), "PAGE005"
    )
    return joined.select(*key, n.alias("n_shapes"), rule.alias("rule_id"))


def contracted(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the nodes where paths meet, part or begin: doc_id, node, target, inner.

    A node with one reference in and one out that is no root stands in a chain; a chain becomes one edge that
    counts the ``inner`` nodes it passes, found by doubling.  Nothing else leads into a chain but the
    reference to its first node, so it is reached with the edge or not at all.
    """
    key = ["doc_id", "node"]
    out = edges.groupBy(*key).agg(F.count("*").alias("__out"), F.min("target").alias("next"))
    into = edges.groupBy("doc_id", F.col("target").alias("node")).agg(F.count("*").alias("__in"))
    single = out.filter("__out = 1").join(into.filter("__in = 1"), key).join(roots.select(*key), key, "left_anti")
    chained = stored(single.select(*key, "next"))
    marked = chained.select("doc_id", F.col("node").alias("next"), F.col("node").alias("parent"))
    ends = resolve_chains(chained.join(marked, ["doc_id", "next"], "left").select(*key, "parent"), key)
    # Chains that close on themselves are cyclic: no reference leads into them.
    ends = ends.filter("status IS NULL").select(*key, F.col("root").alias("last"), (F.col("depth") + 1).alias("inner"))
    last = chained.select("doc_id", F.col("node").alias("last"), F.col("next").alias("exit"))
    skips = ends.join(last, ["doc_id", "last"]).select("doc_id", F.col("node").alias("target"), "exit", "inner")
    outside = edges.join(chained.select(*key), key, "left_anti")
    return outside.join(skips, ["doc_id", "target"], "left").select(
        *key, F.coalesce("exit", "target").alias("target"), F.coalesce("inner", F.lit(0)).cast("long").alias("inner")
    )


def reachable(roots: DataFrame, refs: DataFrame, limit: int = MAX_EMBEDDED) -> DataFrame:
    """Objects reachable from each document's root: doc_id, n_reached and incomplete.

    ``roots``: doc_id, node.  ``refs``: doc_id, node, target.  Chains are contracted first; then the newest
    nodes are joined to the references until nothing new appears.  A round writes its new nodes only.
    ``incomplete`` says that a document holds more objects than an inspection looks at; the walk and the
    count go on to the end all the same.
    """
    key = ["doc_id", "node"]
    text = lambda f, *names: f.select("doc_id", *[F.col(n).cast("string").alias(n) for n in names]).distinct()
    refs = refs.filter(F.col("node").isNotNull() & F.col("target").isNotNull())
    roots = stored(text(roots, "node"))
    edges = stored(contracted(roots, stored(text(refs, "node", "target"))))  # read every round
    reached = Appended(roots.sparkSession, roots.schema)
    frontier, step = reached.add(roots, 0), 0
    while not frontier.isEmpty():
        step += 1
        next_ = frontier.join(edges, key).select("doc_id", F.col("target").alias("node")).distinct()
        frontier = reached.add(next_.join(reached.all(), key, "left_anti"), step)
    nodes = reached.all().select(*key)
    passed = edges.filter("inner > 0").join(nodes, key, "left_semi").select("doc_id", F.col("inner").alias("n"))
    counted = nodes.select("doc_id", F.lit(1).cast("long").alias("n")).unionByName(passed)
    totals = counted.groupBy("doc_id").agg((F.sum("n") - 1).alias("n"))
    return totals.select("doc_id", F.col("n").alias("n_reached"), (F.col("n") > limit).alias("incomplete"))
