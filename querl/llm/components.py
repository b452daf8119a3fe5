"""Connected components by alternating large-star and small-star steps, all as DataFrame plans.

Each step joins edges with the minimum of each node's neighbours, an aggregate that is combined
before its shuffle. A step's edges go to the shared folder. The number of steps grows with the
logarithm of the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.llm.common import cut_measured


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point at the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point at the least of those; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (u, v): component is the smallest id it is connected with.

    No edges give no rows; loops and repeated edges change nothing.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    while True:
        was = mark
        now, mark = cut_measured(_small_star(_large_star(now)), "edges", n=F.count("*"), h=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if mark == was or not mark["n"]:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
