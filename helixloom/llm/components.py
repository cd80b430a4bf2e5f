"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a grouped minimum and two equi-joins over the edge table; nothing is collected, and
each round's edges are written to the shared folder so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import join_to_one, stored


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    met = join_to_one(both, low, ["u"], "n", 2 * total)
    return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_to_one(down, low, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node of its component.

    Null ends and loops are no edges; repeated edges count once; an empty table gives an empty result.
    The rounds grow with the logarithm of the longest chain, not with the number of rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        large = stored(_large_star(now, now.count()), "edges")
        now = stored(_small_star(large, large.count()), "edges")
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if loose.isEmpty():  # every node hangs on one root, and roots on none
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
