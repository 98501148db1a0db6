"""Near-duplicate vectors by a dual traversal of a cover tree, exact above a cosine threshold.

Vectors are scaled to length one, where a cosine of ``c`` is a distance of ``sqrt(2 - 2 c)``.  A tree of
nested levels with halving radii is built from a bounded sample: a level holds the centres of the level
above and every sampled vector that none of them covers.  The finest level with few enough centres is the
leaf level.  *Every* vector then goes to its nearest leaf if that covers it; those that no leaf covers are
strays.  While many are, a bounded sample of them joins the first one and the tree is built again, so that it
comes to know the groups of the whole table and not only the large ones.  Each leaf's covering radius is the
largest distance that occurs in it, so the bounds hold for all vectors, sampled or not; what strays are left
are one more leaf, which meets all others.

Two nodes are visited together, starting with the root and itself.  If their centres are further apart
than both radii and the threshold's distance, no vector of one links with any of the other and the pair
is dropped; else the larger node is opened.  Pairs of leaves that survive are compared in double
precision, block against block: a leaf of a third of all vectors is many blocks.

Equal vectors are one class with a multiplicity, so exact copies never meet.  A block pair gives sums per
vector and a spanning forest of its links, not the links.

If vectors have no structure that a tree can find (independent directions in many dimensions are all
about as far apart as any radius), no pair is dropped and all blocks meet: exact, but quadratic.

Defined results: a null or zero vector, or one with a null or non-finite component, links with nothing;
so does a row without an id; a shorter vector counts as if zeros followed; equal rows link with each
other; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read
from leafwright.llm.components import components
from leafwright.llm.registry import query
from leafwright.session import stored

COSINE = 0.95
SAMPLE = 2000  # vectors the tree is built from at first, and that each later round adds
ROUNDS = 4
MANY = 0.02  # share of strays that asks for another round
MAX_LEAVES = 2048
LEAST_RADIUS = 0.2
BLOCK = 4096  # vectors of a block
STRIP = 256
PAIRS = 200_000  # pairs of nodes whose distances are computed at once
SMALL = 200_000  # pairs of leaves that may be broadcast
SLACK = 1e-7  # for rounding of distances


def build(sample: np.ndarray, max_leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the root on: (centres as places in ``sample``, parent of each in the level above)."""
    levels = [(np.array([0]), np.array([0]))]
    radius = 1.0
    while radius > LEAST_RADIUS:
        above = levels[-1][0]
        centres, parents = list(above), list(range(len(above)))
        near = sample @ sample[centres].T
        reach = 1 - radius * radius / 2  # the cosine at this distance
        best = near.max(1)
        while True:
            far = int(np.argmin(best))
            if best[far] >= reach or len(centres) > max_leaves:
                break
            parents.append(int(np.argmax(sample[far] @ sample[above].T)))
            centres.append(far)
            best = np.maximum(best, sample @ sample[far])
        if len(centres) > max_leaves:
            break
        levels.append((np.array(centres), np.array(parents)))
        radius /= 2
    return levels


def surviving(levels, sample: np.ndarray, radii: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs of leaves (x <= y) that may hold vectors within ``reach``; ``radii`` is -1 for empty leaves."""
    covering = [radii]
    for depth in range(len(levels) - 1, 0, -1):
        centres, parents = levels[depth]
        away = np.linalg.norm(sample[centres] - sample[levels[depth - 1][0]][parents], axis=1)
        up = np.full(len(levels[depth - 1][0]), -1.0)
        filled = covering[0] >= 0
        np.maximum.at(up, parents[filled], (away + covering[0])[filled])
        covering.insert(0, up)
    x = y = np.zeros(1, np.int64)
    for depth in range(len(levels)):
        centres, cover = sample[levels[depth][0]], covering[depth]
        filled = (cover[x] >= 0) & (cover[y] >= 0)
        x, y = x[filled], y[filled]
        near = np.zeros(len(x), bool)
        for low in range(0, len(x), PAIRS):
            i, j = x[low : low + PAIRS], y[low : low + PAIRS]
            near[low : low + PAIRS] = np.linalg.norm(centres[i] - centres[j], axis=1) <= cover[i] + cover[j] + reach + SLACK
        x, y = x[near], y[near]
        if depth < len(levels) - 1:
            x, y = _opened(x, y, levels[depth + 1][1], len(centres))
    return list(zip(x.tolist(), y.tolist()))


def _opened(x: np.ndarray, y: np.ndarray, parents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of pairs of nodes; of a node with itself each unordered pair once."""
    order, counts = np.argsort(parents, kind="stable"), np.bincount(parents, minlength=n)
    first = np.cumsum(counts) - counts
    many = counts[x] * counts[y]
    pair = np.repeat(np.arange(len(x)), many)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    i, j = order[first[x[pair]] + at // counts[y[pair]]], order[first[y[pair]] + at % counts[y[pair]]]
    once = (x[pair] != y[pair]) | (i <= j)
    return np.minimum(i, j)[once], np.maximum(i, j)[once]


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i and j; a label is the least place of its set."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def classes_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vector, id (the least), m: distinct usable vectors."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & sound & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()
    return rows.filter(usable).groupBy(v.alias("v")).agg(
        F.min(F.col(key).cast("long")).alias("id"), F.count("*").alias("m")
    )


def _units(column, width: int) -> np.ndarray:
    """Vectors scaled to length one, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = np.asarray(column.offsets), np.asarray(column.flatten(), float)
    sizes = np.diff(ends)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _draw(distinct: DataFrame, width: int) -> np.ndarray:
    """``SAMPLE`` vectors at most, by a hash of the id."""
    return _units(distinct.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow().column("v"), width)


def _assigned(distinct: DataFrame, width: int, centres: np.ndarray, reached: float) -> DataFrame:
    """id, m, leaf, away, unit: each vector's nearest centre, or the number of centres if none covers it."""
    shared = distinct.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            units = _units(b.column("v"), width)
            leaf, away = np.zeros(len(units), np.int32), np.zeros(len(units))
            for low in range(0, len(units), STRIP):  # a strip meets all centres at once
                part = units[low : low + STRIP]
                near = (part @ shared.value.T).argmax(1)
                leaf[low : low + STRIP] = near
                away[low : low + STRIP] = np.linalg.norm(part - shared.value[near], axis=1)
            leaf[away > reached] = len(shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("m"), pa.array(leaf), pa.array(away), pa.array([u.tobytes() for u in units], pa.binary())],
                ["id", "m", "leaf", "away", "unit"],
            )

    return stored(distinct.select("id", "m", "v").mapInArrow(assign, "id long, m long, leaf int, away double, unit binary"))


def _pair_table(rows: list[tuple]) -> pa.Table:
    columns = np.array(rows or [(-1, 0, 1, 0, 1)], np.int32).T
    return pa.table(dict(zip(("leaf", "own", "own_n", "other", "other_n"), map(pa.array, columns))))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("long").alias(key), vector)
    distinct = stored(classes_of(rows, key, vector))
    facts = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    count, width = int(facts[0]), int(facts[1])
    reach = float(np.sqrt(2 - 2 * cosine))
    drawn = _draw(distinct, width) if count else np.eye(1, width)
    placed, levels = None, None
    for _ in range(ROUNDS):
        levels = build(drawn, MAX_LEAVES)
        centres = drawn[levels[-1][0]]
        reached = 2.0 ** (2 - len(levels)) if len(levels) > 1 else np.inf  # what a leaf covers
        placed = _assigned(distinct, width, centres, reached)
        strays = placed.filter(F.col("leaf") == len(centres))
        n_strays = strays.count() if len(levels) > 1 else 0
        if n_strays <= MANY * count:
            break
        drawn = np.concatenate((drawn, _draw(distinct.join(strays.select("id"), "id", "left_semi"), width)))
    n_leaves = len(levels[-1][0])
    per_leaf = placed.groupBy("leaf").agg(F.count("*").alias("rows"), F.max("away").alias("radius")).toArrow()
    sizes, radii = np.zeros(n_leaves + 1, np.int64), np.full(n_leaves + 1, -1.0)
    sizes[per_leaf.column("leaf").to_numpy()] = per_leaf.column("rows").to_numpy()
    radii[per_leaf.column("leaf").to_numpy()] = per_leaf.column("radius").to_numpy()
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    meets = surviving(levels, drawn, radii[:-1], reach) if count else []
    if sizes[-1]:
        meets += [(x, n_leaves) for x in range(n_leaves + 1) if sizes[x]]
    both = sorted({(x, y) for x, y in meets} | {(y, x) for x, y in meets})
    # A leaf of one vector has nothing to compare with itself.
    table = [(x, int(first[x]), int(blocks[x]), int(first[y]), int(blocks[y])) for x, y in both if x != y or sizes[x] > 1]
    # At most a row per pair of MAX_LEAVES leaves; its size decides whether it is broadcast.
    pairs = spark.createDataFrame(_pair_table(table))
    pairs = F.broadcast(pairs) if len(table) <= SMALL else pairs
    block = F.col("own") + F.pmod(F.xxhash64("id"), F.col("own_n")).cast("int")
    met = (
        placed.join(pairs, "leaf").withColumn("block", block)
        .withColumn("k", F.explode(F.sequence(F.col("other"), F.col("other") + F.col("other_n") - 1)))
        .select(F.least("block", "k").alias("x"), F.greatest("block", "k").alias("y"), "block", "id", "m", "unit")
    )

    def compare(key, group):
        x, y = (k.as_py() for k in key)
        group = group.sort_by([("block", "ascending"), ("id", "ascending")])
        ids, m, own = (group.column(c).to_numpy() for c in ("id", "m", "block"))
        units = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(len(ids), width)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        split = int((own == x).sum()) if x != y else 0
        for low in range(0, split if x != y else len(ids), STRIP):
            high = min(low + STRIP, split if x != y else len(ids))
            base = split if x != y else low
            near = units[low:high] @ units[base:].T >= cosine
            if x == y:
                near &= np.arange(base, len(ids))[None, :] > np.arange(low, high)[:, None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = i + low, j + base
            links += np.bincount(i, m[j], len(ids)).astype(np.int64) + np.bincount(j, m[i], len(ids)).astype(np.int64)
            label = _forest(label, i, j)
        at = np.flatnonzero(links)
        return pa.table({"id": ids[at], "links": links[at], "to": ids[label[at]]})

    found = stored(met.groupBy("x", "y").applyInArrow(compare, "id long, links long, to long"))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    results = distinct.join(sums, "id", "left").join(whole, "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    in_class = F.when(F.col(key).isNotNull(), F.col(vector)) == F.col("v")
    component = F.coalesce("component_id", key)
    return rows.join(results, in_class, "left").select(
        F.col(key).alias("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"),
    )


OP7_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  SELECT vec_id AS node, vec_id AS least FROM embeddings
  UNION
  SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  (SELECT min(least) FROM reach WHERE node = e.vec_id) AS component_id,
  (SELECT min(least) FROM reach WHERE node = e.vec_id) = e.vec_id AS kept
FROM embeddings e"""


@query("op7_embedding_near_dedup", OP7_SQL)
def op7(spark, sf_dir):
    """Every vector's links and the least vector it is linked with, directly or not."""
    found = near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")
