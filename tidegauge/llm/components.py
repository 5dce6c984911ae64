"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is an aggregation (least neighbour, combined before the shuffle) and
joins on the node, so that a node with very many neighbours is only ever
summed or split, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import written


def _canonical(edges: DataFrame) -> DataFrame:
    """Edges as (larger, smaller) without loops or repeats."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a long, b long): the least node that is reachable.

    Nodes without edges don't appear; loops and repeated edges are ignored and
    rows with a null end take no part. An empty table gives an empty one.
    """
    edges = written(_canonical(edges.where("a is not null and b is not null")))
    state = _state(edges)
    while state[0]:  # O(log^2 n) rounds
        edges = written(_canonical(_small_star(_canonical(_large_star(edges)))))
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
