"""Connected components by alternating stars, with joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.storage import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node (large: those above it, small: those below) to the least node near it."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    least = least.select("node", F.least("node", "low").alias("low"))
    met = near.join(least.hint("merge"), F.col("u") == F.col("node"))  # nodes grow with the input, so they are not broadcast
    moved = met.filter(F.col("v") > F.col("u")).select(F.col("low").alias("a"), F.col("v").alias("b")) if large else met.select("low", "v").union(least.select("low", F.col("node").alias("v"))).toDF("a", "b")
    return moved.filter("a < b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node that an edge (a, b) touches.

    Each round is written to the shared folder, so that lost executors cost one round at most, and the
    round before it is deleted: the folder never holds more than two. Nodes
    whose edges are loops only are left out, as are nulls. Raises if ``most_rounds`` do not suffice.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    before = mark(edges)
    for _ in range(most_rounds):
        last, edges = edges, materialise(_star(_star(edges, True), False), "edges")
        now = mark(edges)
        discard(last)
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
