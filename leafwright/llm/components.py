"""Connected components of a link table, for links of any number.

Links are turned towards smaller ids in alternating steps: every node is linked to the least node of
its neighbourhood, first from the larger side, then from the smaller.  Each step keeps the components,
shortens paths and leaves stars in the end.  A node with very many links is one row after a partial
aggregation on one side of the join and is split by adaptive execution on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: every node of ``links`` with the least id it is connected to."""
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    seen = None
    while True:
        # from the larger side: the neighbours above u go to the least of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = up.filter("u <> v").distinct()
        # from the smaller side: u and its lower neighbours go to the least of those
        lower = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stored(down.union(lower.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen or not now[0]:
            break
        seen = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    heads = stars.select(F.col("component").alias("node")).distinct()
    return stars.union(heads.select("node", F.col("node").alias("component")))
