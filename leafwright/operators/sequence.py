"""Ordered scans that survive a huge group.

A plain ``Window.partitionBy(doc).orderBy(pos)`` puts a whole document in one task.  If one
document holds a third of all rows that task never ends.  Here every group is cut into blocks of
consecutive positions: the scan runs inside a block, each block is reduced to one row before any
shuffle, and the carry from the earlier blocks (one row per block) is added back.  The result
equals the plain window's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.session import cut

BLOCK = 1 << 18  # positions per block
_K = "__group_block"


@dataclass(frozen=True)
class Scan:
    """One running value: its kind, the expression it runs over and whether the row counts."""

    kind: str
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    return Scan("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Scan:
    return Scan("max", value, inclusive)


def last_known(value: Column, inclusive: bool = True) -> Scan:
    """The latest non-null value so far."""
    return Scan("last", value, inclusive)


def previous(value: Column) -> Scan:
    """The preceding row's value, null included; null for the first row of a group."""
    return Scan("lag", value, False)


def scan(
    df: DataFrame,
    keys: list[str],
    pos: str | list[str],
    scans: dict[str, Scan],
    block: Column | int = BLOCK,
) -> DataFrame:
    """Add running columns to ``df``, per ``keys`` in ``pos`` order.

    ``pos`` must be unique per group.  ``block`` is the number of positions in a block, or any
    column that never decreases along the order (for example a prefix of a string position).
    """
    order = [pos] if isinstance(pos, str) else list(pos)
    first = F.col(order[0])
    cut = first - F.pmod(first, F.lit(block)) if isinstance(block, int) else block
    # Group and block are one value that equals itself where it holds nulls: the rows that the window has dealt
    # by it meet their block's carry where they are.
    base = df.withColumn(_K, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], cut.alias("b")))
    inner = Window.partitionBy(_K).orderBy(*order)
    outer = Window.partitionBy(*[f"{_K}.k{i}" for i in range(len(keys))]).orderBy(f"{_K}.b").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    rows = base
    totals, carries = [], []
    for name, spec in scans.items():
        w, t = f"__in_{name}", f"__tot_{name}"
        span = inner.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        if spec.kind == "sum":
            rows = rows.withColumn(w, F.sum(spec.value).over(span))
            totals.append(F.sum(spec.value).alias(t))
            carries.append(F.sum(t).over(outer).alias(t))
        elif spec.kind == "max":
            rows = rows.withColumn(w, F.max(spec.value).over(span))
            totals.append(F.max(spec.value).alias(t))
            carries.append(F.max(t).over(outer).alias(t))
        elif spec.kind == "last":
            rows = rows.withColumn(w, F.last(spec.value, ignorenulls=True).over(span))
            totals.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), at)).alias(t))
            carries.append(F.last(t, ignorenulls=True).over(outer).alias(t))
        elif spec.kind == "lag":
            boxed = F.struct(spec.value.alias("v"))
            rows = rows.withColumn(w, F.lag(boxed).over(inner))
            totals.append(F.max_by(boxed, at).alias(t))
            carries.append(F.last(t).over(outer).alias(t))
        else:
            raise ValueError(f"Unknown scan kind {spec.kind!r}")
    carry = base.groupBy(_K).agg(*totals).select(_K, *carries)
    joined = rows.join(carry, _K, "left")
    result = []
    for name, spec in scans.items():
        w, t = F.col(f"__in_{name}"), F.col(f"__tot_{name}")
        if spec.kind == "sum":
            value = F.coalesce(t, F.lit(0)) + F.coalesce(w, F.lit(0))
        elif spec.kind == "max":
            value = F.greatest(t, w)
        elif spec.kind == "last":
            value = F.coalesce(w, t)
        else:
            value = F.coalesce(w, t)["v"]
        result.append(value.alias(name))
    kept = [c for c in df.columns if c not in scans]
    return joined.select(*kept, *result)


def ordinal(
    df: DataFrame,
    keys: list[str],
    pos: str | list[str],
    name: str = "ordinal",
    block: Column | int = BLOCK,
) -> DataFrame:
    """1-based ordinal of each row in its group."""
    return scan(df, keys, pos, {name: running_sum(F.lit(1).cast("long"))}, block)


def range_ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """1-based ordinal of each row in its group, for positions that no block of fixed size can cut.

    Rows are dealt by ranges of (keys, order), as many as there are shuffle partitions, so a huge group
    is many ranges.  Each range is numbered by itself and shifted by what the earlier ones hold of the
    group.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("__range", *keys).agg(F.count("*").alias("__n"))
    shifts = held.select(
        F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
    )
    same = F.col("__range") == F.col("__r")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"__k_{key}"))
    inside = Window.partitionBy("__range", *keys).orderBy(*order)
    numbered = dealt.withColumn("__at", F.row_number().over(inside)).join(shifts, same)
    return numbered.select(*[c for c in df.columns if c != name], (F.col("__at") + F.col("__shift")).alias(name))


def first_n(df: DataFrame, keys: list[str], order: list, n: int = 8) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark prunes each task to ``n`` rows per group before the shuffle (window group limit), so a
    hot group never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)


def first_list(
    df: DataFrame, keys: list[str], order: list, value: Column, name: str, n: int = 8
) -> DataFrame:
    """Group keys with the ordered list of at most ``n`` values, and nothing unbounded."""
    kept = first_n(df.select(*keys, *_columns(df, keys), value.alias("__v")), keys, order, n)
    pairs = F.sort_array(F.collect_list(F.struct("__n", "__v")))
    return kept.groupBy(*keys).agg(F.transform(pairs, lambda p: p["__v"]).alias(name))


def _columns(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]
