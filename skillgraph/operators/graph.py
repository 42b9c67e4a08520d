"""Measures and parts of a graph given as nodes (node, node_type, label) and edges (a, b, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.functions.text import unit_hash
from skillgraph.operators.components import connected
from skillgraph.operators.selection import best_of_each
from skillgraph.storage import stored


#: Nodes that a search holds are broadcast up to so many (about 50 bytes each), else joined by shuffle.
BROADCAST_NODES = 500_000
# A graph of more nodes or edges is never shown whole.
WHOLE_NODES, WHOLE_EDGES = 8_000, 60_000


def usable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different known nodes."""
    known = nodes.select("node").distinct()
    return edges.where("a <> b").join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")


def degrees(edges: DataFrame, nodes: DataFrame | None = None, weight: str = "weight", directed: bool = False) -> DataFrame:
    """(node, degree, strength) of every node; isolated ones have 0.

    ``directed``: edges lead from a to b; in_degree, out_degree, in_strength and out_strength stand beside their sums.
    """
    at = lambda end, one: edges.select(F.col(end).alias("node"), F.lit(one).alias("into"), F.col(weight).alias("w"))
    ends = at("a", 0).unionByName(at("b", 1))
    measures = [F.count("*").alias("degree"), F.sum("w").alias("strength")]
    if directed:
        for name, here in (("in", F.col("into") == 1), ("out", F.col("into") == 0)):
            measures += [F.count_if(here).alias(f"{name}_degree"), F.coalesce(F.sum(F.when(here, F.col("w"))), F.lit(0)).alias(f"{name}_strength")]
    found = ends.groupBy("node").agg(*measures)
    if nodes is None:
        return found
    names = [c for c in found.columns if c != "node"]
    return nodes.join(found, "node", "left").withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in names})


def component_sizes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(component, size), named by the least node."""
    return connected(edges, nodes).groupBy("component").agg(F.count("*").alias("size"))


def top_components(sizes: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest components with their rank; of equal ones the least first."""
    return sizes.orderBy(F.desc("size"), "component").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))


def component_part(edges: DataFrame, members: DataFrame, component: str, max_nodes: int) -> DataFrame:
    """(node, degree): the ``max_nodes`` nodes of one component with most edges, ties by node. ``members``: node, component."""
    own = members.where(F.col("component") == component).select("node")
    return degrees(usable_edges(edges, own).withColumn("weight", F.lit(1)), own).select("node", "degree").orderBy(F.desc("degree"), "node").limit(max_nodes)


def egos(edges: DataFrame, centers: DataFrame, hops: int, max_nodes: int) -> DataFrame:
    """(center, node, hop, place) for every one of ``centers`` (center) that has an edge: breadth-first, all of them at once.

    Nodes of a center come by hop, then by the place of the parent, then by name; at most ``max_nodes`` of each. One join for
    each hop; what is held for the next is at most ``max_nodes`` nodes of each center.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    asked = centers.select("center").distinct()
    few = asked.count() * max(1, max_nodes) <= BROADCAST_NODES
    held = lambda df: F.broadcast(df) if few else df
    there = both.join(held(asked.withColumnRenamed("center", "a")), "a", "left_semi").select(F.col("a").alias("center")).distinct()
    seen = stored(there.select("center", F.col("center").alias("node"), F.lit(0).alias("hop"), F.lit(1).alias("place")), "ego")
    most = max(1, max_nodes)
    for hop in range(1, max(0, hops) + 1):
        counts = stored(seen.groupBy("center").agg(F.count("*").cast("int").alias("held")).where(F.col("held") < most), "held")
        front = seen.where(F.col("hop") == hop - 1).join(held(counts), "center").select("center", F.col("node").alias("a"), F.col("place").alias("parent"))
        new = both.join(held(front), "a").groupBy("center", F.col("b").alias("node")).agg(F.min("parent").alias("parent"))
        new = new.join(held(seen.select("center", "node")), ["center", "node"], "left_anti")
        at = F.row_number().over(Window.partitionBy("center").orderBy("parent", "node"))
        ranked = new.withColumn("at", at).where(F.col("at") < most).join(held(counts), "center").where(F.col("at") + F.col("held") <= most)
        placed = stored(ranked.select("center", "node", F.lit(hop).alias("hop"), (F.col("at") + F.col("held")).alias("place")), "ego")
        if placed.isEmpty():
            break
        seen = seen.unionByName(placed)
    return seen


def ego(edges: DataFrame, center: str, hops: int, max_nodes: int) -> DataFrame:
    """(node, hop, place): breadth-first from ``center``, at most ``max_nodes`` nodes. An unknown center gives no row."""
    asked = edges.sparkSession.createDataFrame([(center,)], "center string")
    return egos(edges, asked, hops, max_nodes).select("node", "hop", "place")


def hub_networks(edges: DataFrame, nodes: DataFrame, centers: DataFrame, hops: int, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """What lies around each of ``centers`` (center): (center, node, node_type, label, hop, place), and (center, a, b, weight), the ``max_edges`` heaviest edges among a center's nodes, ties by ends."""
    around = stored(egos(edges, centers, hops, max_nodes), "around")
    few = around.count() <= BROADCAST_NODES
    own = around.select("center", "node")
    here = lambda df: F.broadcast(df) if few else df
    inside = edges.where("a <> b").join(here(own.withColumnRenamed("node", "a")), "a").join(here(own.withColumnRenamed("node", "b")), ["center", "b"])
    at = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("weight"), "a", "b"))
    heaviest = inside.withColumn("at", at).where(F.col("at") <= max(0, max_edges)).select("center", "a", "b", "weight")
    named = nodes.select("node", "node_type", "label").join(here(around), "node") if few else around.join(nodes.select("node", "node_type", "label"), "node")
    return named.select("center", "node", "node_type", "label", "hop", "place"), heaviest


def induced(edges: DataFrame, nodes: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Edges among ``nodes``, the heaviest ``max_edges`` of them, ties by ends."""
    own = usable_edges(edges, nodes)
    return own if max_edges is None else own.orderBy(F.desc("weight"), "a", "b").limit(max_edges)


def rendered(edges: DataFrame, nodes: DataFrame, max_edges: int) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with global, local and rendered degree; kept edges; how many edges were clipped)."""
    whole, kept = induced(edges, nodes), induced(edges, nodes, max_edges)
    named = lambda e, n: degrees(e, nodes.select("node")).select("node", F.col("degree").alias(n))
    table = nodes.join(named(edges, "global_degree"), "node", "left").join(named(whole, "local_degree"), "node", "left").join(named(kept, "rendered_degree"), "node", "left")
    return table, kept, max(0, whole.count() - max_edges)


def sample_nodes(nodes: DataFrame, edges: DataFrame, max_nodes: int, seed: int = 42, high_share: float = 0.35) -> DataFrame:
    """A fixed sample of at most ``max_nodes`` nodes: each type by its share (one at least), the part ``high_share`` of it by degree, the rest by a hash.

    Both parts are found by thresholds, so no type is sorted as a whole.
    """
    max_nodes = max(1, max_nodes)
    ranked = stored(degrees(edges.withColumn("weight", F.lit(1)), nodes.select("node", "node_type")).select("node", "node_type", "degree"), "degrees")
    sizes = ranked.groupBy("node_type").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= max_nodes:
        return ranked
    share = F.greatest(F.lit(1), F.round(F.col("n") * F.lit(max_nodes) / F.lit(total))).cast("int")
    quotas = sizes.select("node_type", F.least(share, F.col("n").cast("int")).alias("quota"))
    quotas = stored(quotas.withColumn("high", F.least("quota", F.greatest(F.lit(1), F.round(F.col("quota") * F.lit(high_share)).cast("int")))), "quotas")
    high = stored(best_of_each(ranked, quotas.select("node_type", F.col("high").alias("quota")), "node_type", ("degree",), (F.asc("node"),)), "high")
    drawn = ranked.withColumn("draw", -unit_hash(seed, F.col("node"))).join(F.broadcast(high.select("node")), "node", "left_anti")  # max_nodes at most, and one of each type
    low = best_of_each(drawn, quotas.select("node_type", (F.col("quota") - F.col("high")).alias("quota")), "node_type", ("draw",), (F.asc("node"),)).drop("draw")
    chosen = stored(high.unionByName(low), "sample")
    # What rounding leaves over is filled, or trimmed, by degree.
    rest = ranked.join(F.broadcast(chosen.select("node")), "node", "left_anti").orderBy(F.desc("degree"), "node").limit(max(0, max_nodes - chosen.count()))
    return chosen.orderBy(F.desc("degree"), "node").limit(max_nodes).unionByName(rest)


def hubs(edges: DataFrame, nodes: DataFrame, n: int = 300) -> DataFrame:
    """(node, label, global_degree): features with most edges."""
    counted = nodes.where("node_type = 'skill'").join(degrees(edges.withColumn("weight", F.lit(1))).select("node", F.col("degree").alias("global_degree")), "node", "left")
    return counted.select("node", "label", F.coalesce("global_degree", F.lit(0)).cast("long").alias("global_degree")).orderBy(F.desc("global_degree"), "label", "node").limit(n)


def matching(nodes: DataFrame, job_id: str | None, pattern: str | None, limit: int) -> DataFrame:
    """Job nodes by id (none if there is no such id); without one by a regular expression on the label; without that the first ones."""
    jobs = nodes.where("node_type = 'job'")
    if job_id and job_id.strip():
        jobs = jobs.where(F.col("node") == job_id.strip())
    elif pattern and pattern.strip():
        jobs = jobs.where(F.lower("label").rlike(pattern.strip().lower()))
    return jobs.orderBy("node").limit(limit)


def degree_histogram(degree: DataFrame, bins: int = 40) -> DataFrame:
    """(node_type, bin, n): equal bins over the range of all degrees; bins count from 1."""
    low, high = degree.agg(F.min("degree"), F.max("degree")).first()
    if low is None:
        return degree.select("node_type", F.lit(1).alias("bin")).groupBy("node_type", "bin").agg(F.count("*").alias("n"))
    width = max(1e-9, (high - low) / bins)
    at = F.least(F.lit(bins), (F.floor((F.col("degree") - low) / width) + 1)).cast("int")
    return degree.select("node_type", at.alias("bin")).groupBy("node_type", "bin").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Overview:
    """A graph at a glance, and the part of it that is shown."""

    nodes: int
    edges: int
    components: int
    sampled: bool
    clipped: int
    types: DataFrame  # node_type, n
    histogram: DataFrame  # node_type, bin, n
    largest: DataFrame  # component, size, rank
    shown: DataFrame  # nodes with global_degree, local_degree, rendered_degree
    links: DataFrame


def overview(nodes: DataFrame, edges: DataFrame, whole: bool = False, max_nodes: int = 1_000, max_edges: int = 3_000, seed: int = 42, components: int = 20) -> Overview:
    """Counts, degrees and components of a graph, and what is shown of it: all nodes if ``whole`` is asked for and the graph is small enough, else a sample.

    Degrees and members of components are written once, and all counts come from them.
    """
    links = stored(usable_edges(edges, nodes), "links")
    degree = stored(degrees(links.withColumn("weight", F.lit(1)), nodes.select("node", "node_type", "label")).drop("strength"), "degrees")
    sizes = stored(component_sizes(links, nodes), "sizes")
    n, m = degree.count(), links.count()
    sampled = not whole or n > WHOLE_NODES or m > WHOLE_EDGES
    picked = sample_nodes(nodes, links, max_nodes, seed).select("node") if sampled else nodes.select("node")
    chosen = stored(degree.join(picked, "node", "left_semi").select("node", "node_type", "label"), "chosen")
    shown, kept, clipped = rendered(links, chosen, max_edges)
    types = degree.groupBy("node_type").agg(F.count("*").alias("n"))
    return Overview(n, m, sizes.count(), sampled, clipped, types, degree_histogram(degree), top_components(sizes, components), shown, kept)
