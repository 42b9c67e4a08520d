"""Connected components of a distributed list of edges: union-find as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgraph.llm.common import stored


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Each round hangs the greater neighbours of every node, and the node
    itself, on its least neighbour (large star, then small star); edges
    shrink to stars around each component's least node in a logarithmic number
    of rounds. A node's neighbours are never collected: only their minimum is
    taken, and that is summed before the shuffle. Rounds are written to the
    shared folder, so no lineage grows and lost executors cost nothing.

    Defined cases: null ends are left out, repeated edges count once, an edge
    from a node to itself gives that node as its own root.
    """
    edges = stored(edges.select("a", "b").where("a is not null and b is not null"), "links")
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = stored(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).unionByName(
        loops.join(rooted.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours go to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours, and the node itself, go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
