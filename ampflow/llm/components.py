"""Connected components by alternating star contractions, all of it in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import durable


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("hi"), F.least("m", "u").alias("lo"))
        .where("hi > lo")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of those."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node of its component.

    edges has two bigint columns, in any order and repeated at will; loops are dropped. Each
    round halves the depth of what is left, about; every round is written to the shared
    checkpoint folder, so a lost executor costs at most one round.
    """
    a, b = edges.columns
    now = durable(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    )
    state = _state(now)
    while state[0]:
        now = durable(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo"), F.col("lo")).distinct()
    )
