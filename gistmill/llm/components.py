"""Connected components of an edge table by alternating large-star and small-star rounds.

Follows the public map-reduce algorithm (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). Every step is a minimum per node, which Spark combines
before the shuffle. The minima are written before they are joined back to the edges, so
that a node with very many neighbours is a skewed key of a plain join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both(edges)
    least = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
    return pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "minima")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Nodes without an edge do not appear. Empty input gives an empty table. Nulls, loops
    and repeated edges are ignored.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), "edges")
        new = _state(after)
        now, done = after, new == state
        state = new
        if done:
            break
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )
