"""Connected components of a distributed list of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgraph.storage import stored

#: Edges that a task holds at once, and below which more tasks don't pay.
EDGES_AT_ONCE, EDGES_AT_LEAST = 1_000_000, 20_000
#: Of so many edges one is looked at to tell nodes with ``HUB`` edges or more, about, whose edges go to many tasks. This deals edges out, and leaves none away.
LOOKED_AT, HUB = 1_000, 200_000


def _tasks(spark: SparkSession, rows: int) -> int:
    """By rows, as bytes tell little here: stars have one end in common and are all but nothing when compressed."""
    return max(1, -(-rows // EDGES_AT_ONCE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // EDGES_AT_LEAST)))


def _hubs(edges: DataFrame) -> DataFrame | None:
    """(a, _hub) of the ends that have very many edges, or None; one for each ``HUB`` edges at most, about."""
    ends = edges.where(F.pmod(F.xxhash64("a", "b"), F.lit(LOOKED_AT)) == 0).select(F.explode(F.array("a", "b")).alias("a"))
    found = [r["a"] for r in ends.groupBy("a").count().where(F.col("count") >= max(1, HUB // LOOKED_AT)).collect()]
    return edges.sparkSession.createDataFrame([(a, 1) for a in found], edges.select("a", F.lit(1).alias("_hub")).schema) if found else None


def _with_least(pairs: DataFrame, hubs: DataFrame | None, n: int, distinct: bool = False) -> DataFrame:
    """``pairs`` (a, b), and m: the least b of each a. Dealt to ``n`` tasks by a, those of hubs by b too."""
    once = (lambda df: df.distinct()) if distinct else lambda df: df  # in their tasks, as equal pairs go to one
    if hubs is None:
        own = once(pairs.repartition(n, "a"))
        return own.join(own.groupBy("a").agg(F.min("b").alias("m")).hint("shuffle_hash"), "a")
    salt = F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(n))).otherwise(F.lit(-1)).alias("s")
    own = once(pairs.join(F.broadcast(hubs), "a", "left").select("a", "b", salt).repartition(n, "a", "s"))
    parts = own.groupBy("a", "s").agg(F.min("b").alias("m"))
    whole = parts.where("s >= 0").groupBy("a").agg(F.min("m").alias("w"))  # a row for each hub
    found = own.join(parts.hint("shuffle_hash"), ["a", "s"]).join(F.broadcast(whole), "a", "left")
    return found.select("a", "b", F.coalesce("w", "m").alias("m"))


def connected(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """(node, component): component is the least node that can be reached. ``edges``: a, b; ``nodes``: node, for isolated ones.

    Large-star and small-star rounds: every node hangs its neighbours on the least of them, so edges shrink to stars in a
    logarithmic number of rounds. Edges are dealt out before minima are taken and meet these in hash joins, so a task holds
    about ``EDGES_AT_ONCE`` edges at any size of the graph, of its components and of its hubs.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before, n = None, 1
    for _ in range(max_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, n = state, _tasks(spark, 2 * state[0])
        hubs = _hubs(now) if state[0] > HUB else None
        both = _with_least(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), hubs, n)
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = _with_least(large, hubs, n, distinct=True).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.repartition(n, "a", "b").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    some = now.select("b", F.pmod(F.xxhash64("a"), F.lit(16 * n)).alias("s")).repartition(n, "s").distinct()  # so that a root of many doesn't go to one task each time
    roots = some.select("b").repartition(n, "b").distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
    if nodes is None:
        return found
    known, n = nodes.select("node"), _tasks(spark, 2 * before[0] + nodes.count())
    return known.repartition(n, "node").distinct().join(found.repartition(n, "node").hint("shuffle_hash"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
