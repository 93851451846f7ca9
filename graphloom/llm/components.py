"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    # Written, so that the join has plain sides: small ones are broadcast, and of large ones AQE splits a hub's edges.
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the least of them. Takes and gives a > b."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    edges: columns a and b of one ordered type; direction, repeats, self-loops and nulls do not matter (the
    last two are dropped). No edges: no rows. Each round is two grouped minima and two joins on the node; minima
    are combined before the shuffle, joins of a hub can be split, and rounds grow with the logarithm of the longest chain.
    """
    edges = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select("b", "b").distinct()
            )
        state = now
        edges = written(_small_star(written(_large_star(edges))))
