"""Connected components of a graph in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.session import checkpoint, release


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a long, b long); component is the smallest id that links reach.

    Alternates large-star and small-star steps: each node's larger, then smaller, neighbours are hung
    on its smallest one, until nothing changes. A step is a grouped minimum, combined before its
    shuffle, and a join, so that a hub's links are never gathered; the steps grow with the logarithm
    of the largest component.
    """
    own = checkpoint(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    before = None
    while True:
        both = own.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, own = own, checkpoint(small.distinct())
        release(old)
        now = own.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if now == before or now[0] == now[2] and not own.join(own.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break  # every node has one parent, and no parent has one
        before = now
    roots = own.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return own.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
