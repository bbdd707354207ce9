"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.session import stage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFFFF)).alias("h")).first()
    return row["n"], row["h"] or 0


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links (a, b)``: the smallest node that can be reached.

    Alternates two steps until nothing changes: hand the larger neighbours of every node over to the smallest one,
    then the smaller ones. The number of links never grows and the paths shrink by half. The smallest neighbour
    comes from an aggregate that is joined back, so that a node with very many links is no single task.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stage(links.where("a <> b").select(a, b).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        handed = both.where("v > u").join(smallest, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        handed = stage(handed.distinct(), "larger")
        smallest = handed.groupBy("b").agg(F.min("a").alias("m"))
        # A node keeps its smallest neighbour, and its other neighbours move over to that one.
        moved = handed.join(smallest, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
        edges = smallest.select(F.col("m").alias("a"), "b").union(moved.select(F.least("x", "y"), F.greatest("x", "y")))
        edges = stage(edges.distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return ends.union(roots)
