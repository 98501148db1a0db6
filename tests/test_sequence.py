"""Block scans equal plain windows wherever the blocks end, also for one hot group."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafwright.operators import sequence as seq
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    # Two thirds of the rows belong to group 0.
    base = spark.range(0, 600, numPartitions=7).withColumn("g", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 5))
    value = F.when(F.col("id") % 4 != 0, (F.col("id") * 7919) % 101)
    return base.withColumn("v", value).cache()


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
def test_scan_equals_window(data, block):
    w = Window.partitionBy("g").orderBy("id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = data.select(
        "g", "id", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"),
        F.last("v", True).over(before).alias("l"), F.lag("v").over(w).alias("p"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("e"),
    )
    got = seq.scan(
        data, ["g"], "id",
        {
            "s": seq.running_sum(F.col("v")), "m": seq.running_max(F.col("v")),
            "l": seq.last_known(F.col("v"), inclusive=False), "p": seq.previous(F.col("v")),
            "e": seq.running_sum(F.col("v"), inclusive=False),
        },
        block,
    )
    columns = ["g", "id", "s", "m", "l", "p", "e"]
    assert rows(got, *columns) == rows(want, *columns)


def test_ordinal_by_prefix_blocks(data):
    named = data.withColumn("path", F.format_string("p%06d", "id"))
    got = seq.ordinal(named, ["g"], "path", block=F.substring("path", 1, 5))
    want = named.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("path")).cast("long"))
    assert rows(got, "g", "path", "ordinal") == rows(want, "g", "path", "ordinal")


def test_null_group_is_a_group(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "g int, pos long")
    got = seq.ordinal(frame, ["g"], "pos", block=1)
    assert rows(got, "pos", "ordinal") == [(1, 1), (2, 2), (3, 1)]


def test_first_list_is_bounded_and_ordered(data):
    got = seq.first_list(data, ["g"], ["id"], F.col("id"), "ids", 3).filter("g = 0").first()
    assert got["ids"] == [0, 1, 3]


def test_first_n_prunes_before_the_shuffle(data):
    plan = seq.first_n(data, ["g"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_partition_count_does_not_matter(data):
    one = seq.ordinal(data.coalesce(1), ["g"], "id", block=20)
    many = seq.ordinal(data.repartition(13), ["g"], "id", block=20)
    assert rows(one, "g", "id", "ordinal") == rows(many, "g", "id", "ordinal")
