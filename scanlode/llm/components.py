"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is joins and minima over the edges, so no node's neighbours are
ever gathered in one place. The edge table is cut from its lineage in the shared
folder after each round; the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import discard, materialize

MOST_ROUNDS = 60


#: Parts that a node's neighbours are dealt into, so that a star's centre is no hot key.
PARTS = 64


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges(a, b)`` with m of ``least(a, m)``: the least goes once to each part of a node's neighbours that is there."""
    rows = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    return rows.join(rows.select("a", "part").distinct().join(least, "a"), ["a", "part"]).select("a", "b", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, point to the least neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of every node that has an edge; ``edges(a, b)`` of longs."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        # A forest of stars, each node above one centre that is below no other, is what both steps leave as it is.
        tops = now.select(F.col("b").alias("a")).distinct()
        many = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not many and not now.join(tops, "a", "left_semi").limit(1).count():
            break
        before, now = now, materialize(_small(_large(now)), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    ends = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
