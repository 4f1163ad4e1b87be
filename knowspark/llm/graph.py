"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, label): the smallest node of each component, for nodes that are not it.

    Every step is an aggregate with partial sums and a join; a node's
    neighbours are never gathered.  The steps end when the edges form stars:
    no node has two edges upwards, and no node is both an end and a centre.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
        if odd.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hop.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
