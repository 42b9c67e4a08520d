"""Closeness and betweenness by breadth-first search from every vertex.

Where the adjacency is of bounded size it is broadcast, and the sources are dealt to
tasks. Larger graphs go by joins, many sources at a time, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgraph.operators.components import connected
from skillgraph.operators.graph import degrees
from skillgraph.sources.tabular import numbered
from skillgraph.storage import released, scratch_path, stored, tasks_for


#: The widest limits of any profile: what the driver collects and broadcasts never holds more vertices and edges.
MOST = (60_000, 4_000_000)
#: In larger graphs: longs of a row, with a bit for each source; rows that a level sends at a time, about, and those of a task.
WORDS, ROWS_AT_ONCE, ROWS_OF_A_TASK = 8, 50_000_000, 500_000


def guard(vertices: int, edges: int, limit: tuple[int, int] | None, prefix: str = "") -> str | None:
    """Why a measure is left out, or None."""
    if limit is None:
        return "disabled_by_config"
    if vertices > limit[0] or edges > limit[1]:
        return f"guarded_by_size({prefix}v={vertices},{prefix}e={edges},v_limit={limit[0]},e_limit={limit[1]})"
    return None


def _adjacency(edges: DataFrame, limit: tuple[int, int]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(node, id) with ids from 0, and neighbours by id. Names stay in Spark; two numbers for each edge come to the driver.

    ValueError for more vertices or edges than ``limit``: that bounds what is collected and broadcast.
    """
    nodes = numbered(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "id")
    n, m = nodes.count(), edges.count()
    if why := guard(n, m, limit):
        raise ValueError(why)
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("id").cast("int").alias(f"{end}_id"))
    pairs = edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a_id", "b_id").toArrow()
    a, b = (pairs.column(c).to_numpy() for c in ("a_id", "b_id"))
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    return nodes, np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]), np.concatenate([b, a])[order]


def _levels(start: np.ndarray, to: np.ndarray, source: int, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Vertices by distance, distances, numbers of shortest paths, and the edges between levels."""
    distance, paths = np.full(n, -1), np.zeros(n)
    distance[source], paths[source] = 0, 1
    front, levels, steps = np.array([source]), [np.array([source])], []
    while len(front):
        counts = start[front + 1] - start[front]
        tail = np.repeat(front, counts)
        head = to[np.repeat(start[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        new = distance[head] < 0
        distance[head[new]] = len(levels)
        forward = distance[head] == len(levels)
        tail, head = tail[forward], head[forward]
        np.add.at(paths, head, paths[tail])
        front = np.unique(head)
        if len(front):
            levels.append(front)
            steps.append((tail, head))
    return levels, distance, paths, steps


def path_measures(edges: DataFrame, betweenness: bool = True, limit: tuple[int, int] = MOST) -> DataFrame:
    """(node, betweenness, distance_sum, reached) of every vertex with an edge; undirected, unweighted, edges distinct.

    Betweenness is not normalised; every pair of vertices counts once. ValueError beyond ``limit`` vertices and edges.
    """
    spark = edges.sparkSession
    nodes, start, to = _adjacency(stored(edges.select("a", "b"), "pairs"), limit)
    shared = spark.sparkContext.broadcast((start, to))
    n = len(start) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, to = shared.value
        total = np.zeros(n)
        for batch in batches:
            rows = []
            for s in batch["id"]:
                levels, distance, paths, steps = _levels(start, to, int(s), n)
                rows.append((int(s), 0.0, int(distance[distance > 0].sum()), int((distance >= 0).sum())))
                if betweenness:
                    share = np.zeros(n)
                    for tail, head in reversed(steps):
                        np.add.at(share, tail, paths[tail] / paths[head] * (1 + share[head]))
                    share[int(s)] = 0
                    total += share
            yield pd.DataFrame(rows, columns=["id", "betweenness", "distance_sum", "reached"])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "betweenness": total[at] / 2, "distance_sum": 0, "reached": 0})

    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, n, 1, parts).mapInPandas(run, "id long, betweenness double, distance_sum long, reached long").groupBy("id").agg(F.sum("betweenness").alias("betweenness"), F.sum("distance_sum").alias("distance_sum"), F.sum("reached").alias("reached"))
    return nodes.join(found, "id").select("node", "betweenness", "distance_sum", "reached")


def _spread(ways: DataFrame, start: DataFrame, tasks: int) -> DataFrame:
    """(v, distance_sum, reached) of the vertices that the sources of ``start`` reach: ``start`` holds (v, k, seen and front of each word).

    A row (v, k) tells by bits which sources of block k have met v. Each level sends the newly met ones to all neighbours, where
    they are put together by OR; distances are the same both ways, so what v adds up is the sum of its own distances.
    """
    words = range(WORDS)
    now, level = stored(start.withColumn("far", F.lit(0).cast("long")), "reached"), 0
    while not now.where("front").isEmpty():
        level += 1
        sent = now.where("front").select(F.col("v").alias("u"), "k", *[f"f{i}" for i in words]).join(ways, "u").drop("u")
        met = sent.repartition(tasks, "v", "k").groupBy("v", "k").agg(*[F.bit_or(f"f{i}").alias(f"m{i}") for i in words])
        own = now.select("v", "k", "far", *[f"s{i}" for i in words]).repartition(tasks, "v", "k")
        seen = own.join(met, ["v", "k"], "full").na.fill(0)
        new = seen.select("v", "k", "far", *[f"s{i}" for i in words], *[F.col(f"m{i}").bitwiseAND(F.bitwise_not(f"s{i}")).alias(f"f{i}") for i in words])
        fresh = sum((F.bit_count(f"f{i}") for i in words), F.lit(0))
        after = stored(new.select("v", "k", (F.col("far") + F.lit(level) * fresh).alias("far"), (fresh > 0).alias("front"), *[F.col(f"s{i}").bitwiseOR(F.col(f"f{i}")).alias(f"s{i}") for i in words], *[f"f{i}" for i in words]), "reached")
        released(now)
        now = after
    return now.groupBy("v").agg(F.sum("far").alias("distance_sum"), F.sum(sum((F.bit_count(f"s{i}") for i in words), F.lit(0))).cast("long").alias("reached"))


def _numbered_ways(edges: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(vertices (node, id), edges both ways (u, v) by id, how many vertices, how many ways)."""
    nodes = stored(numbered(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "id"), "vertices")
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    one = stored(edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a_id", "b_id"), "ways")
    return nodes, one.toDF("u", "v").unionByName(one.toDF("v", "u")), nodes.count(), 2 * one.count()


def distance_sums(edges: DataFrame) -> DataFrame:
    """(node, distance_sum, reached) of every vertex with an edge, as ``path_measures`` gives them, of a graph of any size.

    Nothing is collected or broadcast, and no task holds the graph: as many blocks of sources go together as make about
    ``ROWS_AT_ONCE`` rows a level, one after another. Work is edges times vertices, since all pairs of vertices are looked at.
    """
    spark = edges.sparkSession
    nodes, ways, n, rows = _numbered_ways(edges)
    block, path = 64 * WORDS, scratch_path(spark, "distances")
    step = block * max(1, ROWS_AT_ONCE // max(1, rows))
    bit, word = F.expr("shiftleft(1L, cast(v % 64 as int))"), F.expr(f"v div 64 % {WORDS}")
    bits = lambda name: [F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(f"{name}{i}") for i in range(WORDS)]
    for first in range(0, n, step):
        sources = nodes.where((F.col("id") >= first) & (F.col("id") < first + step)).select(F.col("id").alias("v"))
        start = sources.select("v", F.expr(f"v div {block}").alias("k"), F.lit(True).alias("front"), *bits("s"), *bits("f"))
        tasks = tasks_for(spark, rows * -(-min(step, n - first) // block), ROWS_OF_A_TASK)
        _spread(ways, start, tasks).write.mode("append").parquet(path)
    if not n:
        return nodes.select("node", F.lit(0).cast("long").alias("distance_sum"), F.lit(0).cast("long").alias("reached"))
    found = spark.read.schema("v long, distance_sum long, reached long").parquet(path).groupBy("v").agg(F.sum("distance_sum").alias("distance_sum"), F.sum("reached").alias("reached"))
    return nodes.join(found.withColumnRenamed("v", "id"), "id").select("node", "distance_sum", "reached")


def _shares(ways: DataFrame, sources: DataFrame, tasks: int) -> DataFrame:
    """(v, share) of what the shortest paths from ``sources`` (s) give to each vertex on their way.

    Numbers of shortest paths are counted level by level; then each level gives to the one before it.
    """
    levels = [stored(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("n")), "level")]
    while True:
        sent = levels[-1].withColumnRenamed("v", "u").join(ways, "u").select("s", "v", "n").repartition(tasks, "s", "v")
        new = sent.groupBy("s", "v").agg(F.sum("n").alias("n"))
        for known in levels[-2:]:  # a neighbour lies one level off at most
            new = new.join(known.select("s", "v"), ["s", "v"], "left_anti")
        levels.append(stored(new, "level"))
        if levels[-1].isEmpty():
            break
    given = shares = stored(levels[-2].withColumn("share", F.lit(0.0)), "share")
    for level in levels[-3:0:-1]:
        back = given.select("s", F.col("v").alias("u"), ((F.col("share") + 1) / F.col("n")).alias("part")).join(ways, "u").repartition(tasks, "s", "v").groupBy("s", "v").agg(F.sum("part").alias("part"))
        given = stored(level.join(back, ["s", "v"], "left").select("s", "v", "n", (F.col("n") * F.coalesce("part", F.lit(0.0))).alias("share")), "share")
        shares = shares.unionByName(given)
    found = stored(shares.groupBy("v").agg(F.sum("share").alias("share")), "shares")
    for df in [*levels, shares]:
        released(df)
    return found


def path_shares(edges: DataFrame) -> DataFrame:
    """(node, betweenness) of every vertex with an edge, as ``path_measures`` gives it, of a graph of any size; see ``distance_sums``."""
    spark = edges.sparkSession
    nodes, ways, n, rows = _numbered_ways(edges)
    path, step = scratch_path(spark, "betweenness"), max(1, ROWS_AT_ONCE // max(1, rows))
    for first in range(0, n, step):
        sources = nodes.where((F.col("id") >= first) & (F.col("id") < first + step)).select(F.col("id").alias("s"))
        found = _shares(ways, sources, tasks_for(spark, rows * min(step, n - first), ROWS_OF_A_TASK))
        found.write.mode("append").parquet(path)
        released(found)
    if not n:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    found = spark.read.schema("v long, share double").parquet(path).groupBy(F.col("v").alias("id")).agg((F.sum("share") / 2).alias("betweenness"))
    return nodes.join(found, "id", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _largest(edges: DataFrame, nodes: DataFrame) -> tuple[int, DataFrame]:
    """How many vertices the largest component has (of equal ones, that of the least node), and its edges."""
    members = stored(connected(edges, nodes), "members")
    top = members.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    giant = members.where(F.col("component") == top[0]).select("node") if top else members.select("node")
    return top[1] if top else 0, edges.join(giant.withColumnRenamed("node", "a"), "a", "left_semi")


def _nearness(edges: DataFrame, n: int, m: int) -> DataFrame:
    """(node, closeness) of a connected graph of n vertices and m edges: (n - 1) / sum of distances."""
    sums = distance_sums(edges) if guard(n, m, MOST) else path_measures(edges, betweenness=False)
    return sums.select("node", ((F.col("reached") - 1) / F.col("distance_sum")).alias("closeness"))


def _betweenness(edges: DataFrame, table: DataFrame, n: int, m: int) -> DataFrame:
    """``table`` (node, ...) with the betweenness of each node in a graph of n vertices and m edges."""
    between = path_shares(edges) if guard(n, m, MOST) else path_measures(edges)
    return table.join(between.select("node", "betweenness"), "node", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, strength, betweenness), of a graph of any size."""
    return _betweenness(edges, degrees(edges, nodes), nodes.count(), edges.count())


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, closeness) of the vertices of the largest component, of a graph of any size."""
    n, inside = _largest(edges, nodes)
    inside = stored(inside.select("a", "b"), "largest")
    return _nearness(inside, n, inside.count())


def centrality(edges: DataFrame, nodes: DataFrame, betweenness_limit: tuple[int, int] | None, closeness_limit: tuple[int, int] | None, counted: tuple[int, DataFrame] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(node, degree, strength, betweenness, closeness) and why a measure is missing.

    Closeness holds for the largest component only (of equal ones, that of the least node), as (n - 1) / sum of distances;
    a measure that the limits leave out is NULL. ``counted``: the number of edges and the (node, degree, strength) of their
    ends, where these are known; edges are then made only for a measure.
    """
    if counted is None or closeness_limit is not None:
        edges = stored(edges.select("a", "b", "weight"), "graph")
    if counted is None:
        e, table = edges.count(), degrees(edges, nodes)
    else:
        e, known = counted
        table = nodes.join(known, "node", "left").withColumns({c: F.coalesce(c, F.lit(0).cast(known.schema[c].dataType)) for c in ("degree", "strength")})
    v = nodes.count()
    notes = {}
    why = guard(v, e, betweenness_limit)
    notes["betweenness"] = why or "computed"
    if why:
        table = table.withColumn("betweenness", F.lit(None).cast("double"))
    else:
        table = _betweenness(edges, table, v, e)
    if closeness_limit is None:
        notes["closeness"] = guard(0, 0, None)
        return table.withColumn("closeness", F.lit(None).cast("double")), notes
    n, inside = _largest(edges, nodes)
    m = inside.count()
    why = guard(n, m, closeness_limit, "giant_")
    notes["closeness"] = why or "computed"
    if why:
        return table.withColumn("closeness", F.lit(None).cast("double")), notes
    return table.join(_nearness(inside, n, m), "node", "left"), notes
