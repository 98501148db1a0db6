"""Sharding by a lookup table that shards fill by permutation.

A table has a prime number of slots.  Each shard prefers the slots in an order of its own,
``(offset + k * skip) mod slots``; the shards take turns, each claiming its most preferred free slot,
until the table is full.  Every shard thus owns the same number of slots, give or take one, and when
a shard joins or leaves few slots change hands.  A row's key picks a slot, and a broadcast join with
the table (its size is the parameter ``slots``, whatever the data) finds the shard in constant time.

The table is filled by one SQL fold whose state is a byte string (two bytes a slot) and each shard's
next preference; no Python touches rows.

Defined results: a null key goes to the slot of the empty key; equal keys, and so repeated rows, go to
the same shard; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm.common import read
from leafwright.llm.registry import query

SLOTS = 16381  # a prime; about a hundred or more slots a shard keep shards within one per cent
SHARDS = 64
PROBE = 48  # preferences looked at first; the whole order is searched if none of them is free


def digest(key: Column) -> Column:
    """A number below 2^60 from a key's text; the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def lookup(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, shard: the filled table."""
    if not 0 < shards <= slots < 1 << 16 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime below 65536 and not less than the number of shards")
    number = lambda salt: F.expr(
        f"transform(sequence(0, {shards - 1}), i -> cast(conv(substring(md5(concat('{salt}', i)), 1, 15), 16, 10) as long))"
    )
    start = spark.range(1).select(
        F.transform(number("offset "), lambda x: x % slots).alias("offset"),
        F.transform(number("skip "), lambda x: x % (slots - 1) + 1).alias("skip"),
    )
    # Preference k of shard i is slot (offset + k * skip) mod slots; claimed slots are non-zero pairs.
    slot = f"(offset[i] + k * skip[i]) % {slots}"
    free = f"substring(s.taken, 2 * cast({slot} as int) + 1, 2) = X'0000'"
    first = lambda low, high: f"get(filter(sequence({low}, {high}), k -> {free}), 0)"
    turn = f"""
      named_struct(
        'taken', overlay(s.taken placing unhex(lpad(hex(i + 1), 4, '0'))
                 from 2 * cast((offset[i] + found * skip[i]) % {slots} as int) + 1),
        'next', transform(s.next, (n, j) -> if(j = i, found + 1, n)))
    """
    # A lambda binds a value once: transform over one element, then take it.
    step = f"""
      transform(array(t % {shards}), i ->
        transform(array(coalesce(
            {first("s.next[i]", f"least(s.next[i] + {PROBE}, {slots - 1}L)")},
            {first("s.next[i]", f"{slots - 1}L")})), found -> {turn})[0])[0]
    """
    filled = start.select(
        F.expr(f"""
        aggregate(sequence(0, {slots - 1}),
          named_struct('taken', unhex(repeat('0000', {slots})), 'next', transform(offset, x -> 0L)),
          (s, t) -> {step}).taken
        """).alias("taken")
    )
    owner = lambda s: (
        F.conv(F.hex(F.substring("taken", 2 * s + 1, 2)), 16, 10).cast("int") - 1
    )
    rows = filled.select("taken", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return rows.select("slot", owner(F.col("slot")).alias("shard"))


def place(rows: DataFrame, key: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard``.

    A hot value of another column does not matter: only the key decides, and a key should be unique.
    """
    table = F.broadcast(lookup(rows.sparkSession, shards, slots))
    kept = rows.drop("slot", "shard").withColumn("slot", (digest(F.col(key)) % slots).cast("int"))
    return kept.join(table, "slot").select(*rows.drop("slot", "shard").columns, "slot", "shard")


@query("op8_sharding")
def op8(spark, sf_dir):
    """Every document's slot and shard."""
    return place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")
