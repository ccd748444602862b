"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b) with a > b. Small: what a links to below it goes to the least of these; large: what links to a from above too."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # stored, so that the join deals both sides itself and can split the rows of a node that very many link to
    least = common.stored(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    linked = near.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    else:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("x"), "m")
    return out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (node, label): label is the least node of the component. Nodes without edges are left out."""
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        now = common.stored(_starred(_starred(now, small=False), small=True))
        # done when every edge leads to a node that leads nowhere itself and every node has one edge
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
