"""Connected components of an edge table by joins: no links or components reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b long): the component is its smallest node.

    Large-star and small-star rounds: each node's larger, then smaller, neighbours move to its smallest one, until nothing
    changes. Sums and joins only, so that a node with very many links is split like any skewed join key. Loops, repeated
    edges and null ends don't matter; without edges the result is empty.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        pairs = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = written(pairs, "edges")
        now = _digest(pairs)
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
