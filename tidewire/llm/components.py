"""Connected components by alternating large and small stars, on DataFrames only.

Rounds are written to the shared folder, each in place of the one before; neighbours are never gathered, only their least is aggregated,
so a node with very many neighbours is a skewed join at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) of every node of edges (a, b) of the same kind; loops and repeats don't matter."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        new = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == (new["n"], new["h"]) or new["n"] == 0:
            break
        mark = (new["n"], new["h"])
        large = stored(_large_star(edges), "large-star")
        small = stored(_small_star(large), "small-star")
        forget(edges, large)
        edges = small
    roots = edges.select("b").distinct()
    return edges.union(roots.select("b", "b")).toDF("node", "component")
