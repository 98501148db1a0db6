"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should get.  The whole
part is certain; the rest is a probability that has to become 0 or 1.  Rounding documents one by one
would let a source drift by many documents.  Here two of them meet: as many words as possible move
from one to the other, in a direction drawn so that neither's expectation changes, until one of them is
decided; the other goes on with what is left.  The sum of words never changes, so a source ends within
one document of its target, and every document keeps its expected number of copies.

The pairs form a tree.  A source's documents are spread over blocks of about ``BLOCK`` by a hash, a
fold over each block decides all but one of them, and the remaining ones of all blocks are spread over
fewer blocks, until one per source is left, which goes to
the nearer side.  No group grows with the data, a source of a
third of all rows has a third of all blocks, and ten levels would serve 10^18 documents.  Draws come
from hashes of the document keys, so reruns agree on any cluster.

Only DataFrame and SQL functions are used.  Each level is written to the shared folder.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of its
own and comes last; rows equal in key, source and size are decided as one and taken alike; an empty
table gives an empty result; other columns pass through, and columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm.common import n_words, read
from leafwright.llm.registry import query
from leafwright.session import cut, stored

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_COPIES = 2
BLOCK = 64
RANGES = 32  # ranges in which sources are numbered
SEED = 20240229


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` numbered from 0 by code point, null last, without one big window.

    Rows are dealt by range; each range is numbered by itself and shifted by the sizes of those before.
    """
    dealt = cut(
        rows.repartitionByRange(RANGES, F.col(column).asc_nulls_last()).withColumn(
            "__range", F.spark_partition_id()
        )
    )
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # at most RANGES rows
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    inside = Window.partitionBy("__range").orderBy(F.col(column).asc_nulls_last())
    return (
        dealt.withColumn("__at", F.row_number().over(inside) - 1)
        .join(shifts, "__range")
        .withColumn("rank", F.col("__at") + F.col("__shift"))
        .drop("__range", "__at", "__shift")
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: int = SHARE_PERCENT, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_items, target: the shares after every excess is dealt out again.

    A source is at its limit when its share of what the others leave exceeds it; the sets of limited
    sources only grow, so each round needs the sums of the last one and nothing else.
    """
    per = sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_items")
    )
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    ranked = stored(numbered(per, "source").withColumn("weight", weight.cast("long")))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    limited, seen = F.lit(False), None
    while True:
        # rest is 100 times what the unlimited sources share, heft their weight together
        sums = ranked.agg(
            F.coalesce(
                F.sum(whole("source_size")) * share
                - F.sum(F.when(limited, whole("source_size")).otherwise(0)) * (100 * most),
                F.lit(0),
            ).alias("rest"),
            F.coalesce(F.sum(F.when(~limited, F.col("weight"))), F.lit(0)).alias("heft"),
        ).first()
        if seen == (sums["rest"], sums["heft"]) or not sums["heft"]:
            break
        seen = (sums["rest"], sums["heft"])
        rest, heft = F.lit(int(seen[0])).cast("decimal(38,0)"), F.lit(int(seen[1])).cast("decimal(38,0)")
        limited = (rest * F.col("weight")).cast("double") > (
            whole("source_size") * heft * (100 * most)
        ).cast("double")
    rest, heft = (float(seen[0]), float(seen[1])) if seen else (0.0, 1.0)
    target = F.when(limited, F.col("source_size").cast("double") * most).otherwise(
        F.lit(rest) * F.col("weight") / F.lit(100.0 * heft)
    )
    return ranked.select("source", "source_size", "n_items", target.alias("target"))


# One meeting of the held item h with the next item x; amounts are words.  ``up`` moves words from x to
# h, ``down`` from h to x, each as far as one of the two allows.  Moving up with probability
# down / (up + down) keeps both expectations.
_UNIFORM = "pmod(xxhash64(h.id, x.id, {seed}), 9007199254740992L) / 9007199254740992D"
_MEET = """
  transform(array(named_struct(
      'h', s.hold, 'x', x,
      'up', least(s.hold.a * (1 - s.hold.p), x.a * x.p),
      'down', least(s.hold.a * s.hold.p, x.a * (1 - x.p)))), m ->
    transform(array(named_struct('up', m.up + m.down = 0 or
        {uniform} < m.down / (m.up + m.down))), d ->
      case
        when d.up and m.h.a * (1 - m.h.p) <= m.x.a * m.x.p then {h1}
        when d.up then {x0}
        when m.h.a * m.h.p <= m.x.a * (1 - m.x.p) then {h0}
        else {x1}
      end)[0])[0]
"""


def _fold(seed: int) -> str:
    """SQL that folds the array ``items`` (id, a, p) into ``hold`` and the decided ``out``."""

    def decided(name: str, value: int, other: str, change: str) -> str:
        p = f"greatest(0D, least(1D, m.{other}.p {change} / m.{other}.a))"
        return (
            f"named_struct('hold', named_struct('a', m.{other}.a, 'id', m.{other}.id, 'p', {p}), "
            f"'out', concat(s.out, array(named_struct('id', m.{name}.id, 'extra', {value}))))"
        )

    uniform = _UNIFORM.format(seed=seed).replace("h.id", "m.h.id").replace("x.id", "m.x.id")
    meet = _MEET.format(
        uniform=uniform,
        h1=decided("h", 1, "x", "- m.up"),
        x0=decided("x", 0, "h", "+ m.up"),
        h0=decided("h", 0, "x", "+ m.down"),
        x1=decided("x", 1, "h", "- m.down"),
    )
    return f"""
      aggregate(slice(items, 2, size(items)),
        named_struct('hold', items[0],
          'out', cast(array() as array<struct<id: struct<k: bigint, z: bigint>, extra: int>>)),
        (s, x) -> {meet})"""


def round_copies(items: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """source, id, extra (0 or 1) of items (source, n_items, id struct<k, z>, a words, p in (0, 1))."""
    count = F.col("n_items")
    blocks = F.greatest(F.lit(1), F.ceil(count / block)).cast("long")
    level = items.select("source", blocks.alias("blocks"), "id", "a", "p")
    found, depth = [], 0
    most = items.agg(F.max(blocks)).first()[0] or 0
    while True:
        place = F.pmod(F.xxhash64("id", F.lit(seed + depth)), F.col("blocks"))
        grouped = level.groupBy("source", "blocks", place.alias("block")).agg(
            # large ones first, so that what is left at the end is small
            F.sort_array(F.collect_list(F.struct("a", "id", "p")), asc=False).alias("items")
        )
        done = stored(grouped.select("source", "blocks", F.expr(_fold(seed + depth)).alias("s")))
        found.append(done.select("source", F.explode("s.out").alias("o")).select("source", "o.id", "o.extra"))
        level = done.select(
            "source", F.ceil(F.col("blocks") / block).cast("long").alias("blocks"),
            "s.hold.id", "s.hold.a", "s.hold.p",
        )
        if most <= 1:
            break
        most, depth = -(-most // block), depth + 1
    # One item per source is left; the nearer side keeps the source closest to its target.
    result = level.select("source", "id", (F.col("p") >= 0.5).cast("int").alias("extra"))
    for part in found:
        result = result.unionByName(part)
    return result


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken."""
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in added]
    sized = stored(docs.select(F.col(key).alias("k"), F.col(source).alias("source"), n_words(text).alias("size")))
    goals = stored(targets(sized))
    ratio = F.col("target") / F.col("source_size")
    per_row = F.when(F.col("source_size") > 0, ratio).otherwise(0.0)
    unique = sized.filter(F.col("size") > 0).groupBy("k", "source", "size").agg(F.count("*").alias("m"))
    goal = goals.withColumnRenamed("source", "__gs")
    placed = unique.join(goal, F.col("source").eqNullSafe(F.col("__gs"))).withColumn("ratio", per_row)
    items = placed.select(
        "source", "n_items",
        F.struct(F.col("k").cast("long").alias("k"), F.col("size").cast("long").alias("z")).alias("id"),
        (F.col("size") * F.col("m")).cast("double").alias("a"),
        (F.col("ratio") - F.floor("ratio")).alias("p"),
    ).filter((F.col("p") > 0) & (F.col("p") < 1))
    extras = round_copies(items).select(
        F.col("source").alias("__s"), F.col("id.k").alias("__k"), F.col("id.z").alias("__z"), "extra"
    )
    rows = docs.select(*kept).withColumn("size", n_words(text))
    with_goal = rows.join(
        goal.select("__gs", "source_size", "target"), F.col(source).eqNullSafe(F.col("__gs")), "left"
    )
    # Both sides grow with the corpus, so the rows are moved at every size.
    joined = with_goal.join(
        extras.hint("merge"),
        F.col(key).cast("long").eqNullSafe(F.col("__k")) & (F.col("size") == F.col("__z"))
        & F.col(source).eqNullSafe(F.col("__s")),
        "left",
    )
    copies = F.when(F.col("size") == 0, 0).otherwise(
        F.floor(per_row) + F.coalesce(F.col("extra"), F.lit(0))
    )
    return joined.select(
        *kept, "size", "source_size", "target", copies.cast("long").alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


@query("op6_mixing")
def op6(spark, sf_dir):
    """Every document's size, its source's size and target, and the words taken of it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
