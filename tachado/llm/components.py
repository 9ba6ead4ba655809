"""Connected components of an edge table by alternating large-star and small-star rounds.

All rounds are joins and aggregations; no neighbour list is ever gathered, and each round's edges are
written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(low, "hi").where("lo != m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("hi").alias("a"), F.col("m").alias("b")))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type -> (node, component): the smallest node reachable.

    Nodes without an edge to another node are absent. Nulls never link; self-loops and repeats change
    nothing. Empty edges give an empty table.
    """
    now = Tables(edges.sparkSession)
    e = now(_canonical(edges.where("a is not null and b is not null")), "edges")
    state = _state(e)
    while state[0]:
        last, now = now, Tables(edges.sparkSession)
        e = now(_canonical(_small_star(_canonical(_large_star(e)))), "edges")
        before, state = state, _state(e)
        last.drop()
        if before == state:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo"), F.col("lo")).distinct())
