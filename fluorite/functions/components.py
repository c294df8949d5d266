"""Connected components by contraction, on Spark tables only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluorite.functions.scratch import stage


def connected_components(edges: DataFrame, side: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``edges``: a, b (long). Returns node, component (the smallest node reachable) for every node of an edge between two nodes.

    Each round points every node at its smallest neighbour, or at itself if that is larger, follows the pointers until each node
    points at the end of its chain (their length halves with each step), and replaces the edges by those between these
    ends; edges inside a component vanish. An end has another node pointing at it, so at most half of the nodes remain.
    Pointers go to smaller nodes only, so a component ends at its smallest node. A round's tables are written to the shared
    folder, so the plan doesn't grow. ``side``: what the right side of each join goes through, such as ``shuffled``.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        to = _to_the_end(to, side)
        ends = left.join(side(to.select(F.col("node").alias("a"), F.col("p").alias("pa"))), "a").join(side(to.select(F.col("node").alias("b"), F.col("p").alias("pb"))), "b")
        left = stage(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        nodes = to if nodes is None else stage(_follow(nodes, to, side))
    if nodes is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select("node", F.col("p").alias("component"))


def _to_the_end(to: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    to = stage(to)
    while True:
        further = stage(_follow(to, to, side).withColumnRenamed("p", "q").join(side(to), "node"))
        to = further.select("node", F.col("q").alias("p"))
        if further.where("q <> p").isEmpty():
            return to


def _follow(nodes: DataFrame, to: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node with what ``to`` says of the node it points at."""
    step = to.select(F.col("node").alias("p"), F.col("p").alias("further"))
    return nodes.join(side(step), "p", "left").select("node", F.coalesce("further", "p").alias("p"))
