"""Connected components of a graph too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.llm.common import Scratch

# Edges are a small part of what they come from, and so are the files that hold them.
SHARE = 1 / 16


def _summary(edges: DataFrame) -> tuple[int, int]:
    """Equal for equal sets of edges."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    row = edges.agg(F.count("*").alias("n"), total.alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of every node to the least of them and it.

    The large star moves the neighbours above the node, the small star those below.
    The least neighbour is combined before the shuffle, and the join with it is one
    that adaptive execution can split at a node with very many neighbours.
    """
    around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        around = around.filter("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    moved = around.join(least, "a")
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter("a != b").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b) but the roots themselves.

    The root is the least node of a component. Each round is written to shared storage,
    and the rounds, about the logarithm of the longest path, end when nothing changes.
    """
    now = scratch.stage(edges.filter("a != b").select("a", "b").distinct(), "edges", SHARE, is_light=True)
    before = None
    while (seen := _summary(now)) != before and seen[0]:
        before = seen
        wide = scratch.stage(_star(now, large=True), "large-star", SHARE, is_light=True)
        scratch.drop(now)
        now = scratch.stage(_star(wide, large=False), "small-star", SHARE, is_light=True)
        scratch.drop(wide)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
