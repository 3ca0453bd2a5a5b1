"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of an edge (a, b).

    Large star: what is greater than a node goes to the least of its
    neighbours and itself. Small star: the node and what is smaller go there.
    Alternating them leaves stars around the least nodes after some rounds,
    as many as the logarithm of the graph's size (Kiveris et al. 2014). Least
    neighbours are pre-aggregated, and each round ends in the shared folder.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a != b").distinct())
        mark, before = _mark(edges), mark
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
