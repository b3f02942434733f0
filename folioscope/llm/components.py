"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.frames import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of them; edges run from the larger to the lesser end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another one; component is the least node reachable.

    Edges stay in tables throughout, and no node's neighbours are gathered. Ends when a round leaves the same edges;
    both tables hold each edge once, so equal counts and no edge that is new prove it. Tables of past rounds go.
    """
    a, b = edges.columns[:2]
    current = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = current.count()
    while True:
        stars = written(_small_star(_large_star(current).where("a > b").distinct()).where("a > b").distinct(), "stars")
        after = stars.count()
        if after == before and stars.join(current, ["a", "b"], "left_anti").isEmpty():
            discard(current)
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        discard(current)
        current, before = stars, after
