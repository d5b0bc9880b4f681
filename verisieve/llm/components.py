"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two aggregations and joins over the edges; node minima are combined
before the shuffle, so a hub does not gather in one task. Between rounds the edges
are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisieve.llm.common import forget, stash


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component: the smallest node that it is linked with, for nodes with an edge.

    ``edges`` has two long columns a and b; loops, repeated and reversed edges are allowed.
    Nodes that are their own component's smallest are not listed.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # done when every node has one edge and no edge leads to a node that has one itself
        uneven = now.groupBy("a").count().where("count > 1").select("a").unionByName(now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi"))
        if uneven.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        then = stash(_small(_large(now)))
        forget(now)
        now = then
    raise RuntimeError("components did not settle")
