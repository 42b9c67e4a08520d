"""From a delimited file to entities, graph, closest jobs, measures and reports."""

from __future__ import annotations

import argparse
import dataclasses
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgraph.config import Options
from skillgraph.operators import entities, export, graph, paths, projection, quality, subset
from skillgraph.operators.components import connected
from skillgraph.shipping import ship
from skillgraph.sources import exports, tabular
from skillgraph.storage import stored


@dataclass
class Result:
    jobs: DataFrame
    skills: DataFrame
    edges: DataFrame
    errors: DataFrame
    nodes_table: DataFrame
    edges_table: DataFrame
    topk: DataFrame
    job_metrics: DataFrame
    skill_metrics: DataFrame
    projected_metrics: DataFrame
    summary: dict[str, Any]
    validation: dict[str, Any]
    quality: dict[str, Any]
    seconds: dict[str, float] = field(default_factory=dict)


class _Clock:
    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.last = time.monotonic()

    def stage(self, name: str) -> None:
        now = time.monotonic()
        self.seconds[name] = round(now - self.last, 4)
        self.last = now


def run(spark: SparkSession, path: str, options: Options = Options()) -> Result:
    """Runs all stages. ValueError if no row gives a job."""
    clock = _Clock()
    source = tabular.canonical(tabular.read_csv(spark, path, tabular.sniff_encoding(spark, path, options.encodings)))
    chosen: dict[str, Any] | None = None
    if options.subset_bytes or options.subset_rows:
        rows, chosen = subset.stratified_subset(source, options.subset_bytes or 0, options.subset_seed, options.subset_rows)
        source = tabular.Canonical(tabular.numbered(rows.drop("row_idx"), "row_idx"), source.present, source.missing)
    clock.stage("read")
    built = entities.build(source, options.default_similarity)
    jobs, skills, edges, errors = (stored(df, name) for df, name in ((built.jobs, "jobs"), (built.skills, "skills"), (built.edges, "edges"), (built.errors, "errors")))
    counters = {r["counter"]: r["n"] for r in built.counters.collect()}  # seven rows
    n_jobs, n_skills, n_edges = jobs.count(), skills.count(), edges.count()
    if not n_jobs:
        raise ValueError("no row gives a job")
    warnings = [f"{n_edges} edges"] if n_edges >= options.warn_edges else []
    clock.stage("entities")
    links = edges.select(F.col("job_id").alias("a"), F.col("skill_id").alias("b"), F.col("edge_weight").alias("weight"))
    nodes = jobs.select(F.col("job_id").alias("node"), F.lit("job").alias("node_type"), F.col("job_title").alias("label")).unionByName(skills.select(F.col("skill_id").alias("node"), F.lit("skill").alias("node_type"), "label"))
    ways = ("in_degree", "out_degree") if options.directed else ()
    metrics = graph.degrees(links, nodes, directed=options.directed).select(F.col("node").alias("node_id"), "node_type", "degree", F.col("strength").cast("double").alias("weighted_degree"), *ways)
    sizes = connected(links, nodes).groupBy("component").count().agg(F.count("*"), F.max("count")).first()
    clock.stage("graph")
    judged = stored(projection.guarded(edges, "job_id", "skill_id", "first_seen", options.max_feature_degree, options.max_pairs_per_feature, options.max_total_pairs), "guard")
    names, used = ("job_id", "skill_id", "edge_weight"), judged.where("verdict = 'used'")
    made, members = projection.kind_pairs(edges, *names, used)
    pairs = stored(made, "pairs")
    topk = stored(projection.similar(edges, options.method, options.top_k, options.threshold, *names, used).withColumnsRenamed({"entity": "job_id", "neighbor": "neighbor_job_id"}), "topk")
    clock.stage("projection")
    score = "shared_count" if options.method == "unweighted" else "weighted_score"
    projected = pairs.where(F.col(score) >= options.threshold).select("a", "b", F.col(score).cast("double").alias("weight"), "n_pairs")
    pair_count, edge_count = (df.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0] for df in (pairs, projected))
    job_nodes, known = jobs.select(F.col("job_id").alias("node")), projection.kind_degrees(projected, members, "weight")
    central, notes = paths.centrality(projection.each_pair(projected, members), job_nodes, options.betweenness_limit, options.closeness_limit, (edge_count, known))
    clock.stage("centrality")
    nodes_table, edges_table = export.nodes_table(jobs, skills), export.edges_table(edges)
    checked = quality.report(nodes_table, edges_table, topk)
    validation = {"missing_required_fields": list(source.missing), "validation_error_counts": {k: counters[k] for k in ("missing_job_title", "missing_skills") if counters[k]}, "total_rows": counters["total_rows"], "valid_rows": counters["valid_rows"]}
    summary = {
        "num_jobs": n_jobs, "num_skills": n_skills, "num_edges": n_edges, "density": round(n_edges / (n_jobs * n_skills), 8) if n_skills else None, "num_components": sizes[0], "largest_component_size": sizes[1],
        "parse_failure_count": counters["parse_failure_count"], "dedup_stats": {k: counters[k] for k in ("duplicate_job_rows", "duplicate_job_skill_edges")}, "projection_stats": projection.projection_stats(judged).first().asDict() | {"pair_count": pair_count},
        "projected_graph": {"num_job_nodes": n_jobs, "num_job_edges": edge_count, **notes}, "memory_warnings": warnings, "subset": chosen,
    }
    clock.stage("reports")
    of = lambda kind: metrics.where(F.col("node_type") == kind)
    named = central.select(F.col("node").alias("job_id"), "degree", F.col("strength").cast("double").alias("weighted_degree"), "betweenness", "closeness")
    return Result(jobs, skills, edges, errors, nodes_table, edges_table, topk, of("job"), of("skill"), named, summary, validation, checked, clock.seconds)


def write(spark: SparkSession, result: Result, folder: str, sampled: bool = False) -> None:
    """The eleven outputs of a run."""
    tables = {"nodes": result.nodes_table, "edges": result.edges_table, "job_similarity_topk": result.topk, "parse_errors": result.errors, "job_node_metrics": result.job_metrics, "skill_node_metrics": result.skill_metrics, "projected_job_metrics": result.projected_metrics}
    tables["profiling"] = spark.createDataFrame(list(result.seconds.items()), "stage string, seconds double")
    for name, df in tables.items():
        exports.write_csv(df, exports.output_path(folder, name, sampled))
    for name, report in (("graph_summary", result.summary), ("validation", result.validation), ("qa_report", result.quality)):
        exports.write_json(spark, report, exports.output_path(folder, name, sampled))


def parsed(arguments: list[str] | None = None) -> tuple[str, str, Options]:
    """(input, output folder, options) of a command line."""
    p = argparse.ArgumentParser(description="Skill graph of a file of jobs")
    p.add_argument("--input", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--profile", default="balanced")
    p.add_argument("--similarity-method", "--method", dest="method", choices=("unweighted", "weighted", "both"))
    p.add_argument("--directed", nargs="?", const=True)
    # The names of flags; the shorter ones are this package's own.
    numbers = {
        "top_k": (int, "top-k", None), "threshold": (float, "similarity-threshold", "threshold"), "max_feature_degree": (int, "projection-max-skill-degree", "max-feature-degree"),
        "max_pairs_per_feature": (int, "projection-max-pairs-per-skill", "max-pairs-per-feature"), "max_total_pairs": (int, "projection-max-total-pairs", "max-total-pairs"), "warn_edges": (int, "memory-warning-edge-threshold", "warn-edges"),
        "subset_bytes": (int, "subset-bytes", None), "subset_rows": (int, "subset-target-rows", "subset-rows"), "subset_seed": (int, "subset-seed", None),
    }
    for field_name, (kind, *names) in numbers.items():
        p.add_argument(*[f"--{n}" for n in names if n], dest=field_name, type=kind)
    p.add_argument("--subset-mode", action="store_true", help="only a fixed part of the rows")
    p.add_argument("--subset-target-size-mb", type=int, default=100, help="how much of it, unless rows or bytes are given")
    p.add_argument("--chunksize", type=int, help="accepted; Spark splits files by itself")
    measures = ("betweenness", "closeness")
    for name in measures:
        p.add_argument(f"--disable-{name}", action="store_true")
        for end in ("vertices", "edges"):
            p.add_argument(f"--compute-{name}-max-{end}", f"--{name}-max-{end}", dest=f"{name}_max_{end}", type=int)
    given = vars(p.parse_args(arguments))
    source, folder, profile = (given.pop(k) for k in ("input", "output_dir", "profile"))
    megabytes, wanted = given.pop("subset_target_size_mb"), given.pop("subset_mode")
    if wanted and not (given["subset_bytes"] or given["subset_rows"]):
        given["subset_bytes"] = megabytes << 20
    base, limits = Options.for_profile(profile), {}
    for name in measures:
        off, asked = given.pop(f"disable_{name}"), (given.pop(f"{name}_max_vertices"), given.pop(f"{name}_max_edges"))
        known = getattr(base, f"{name}_limit") or getattr(Options(), f"{name}_limit")
        if off:
            limits[f"{name}_limit"] = None
        elif any(x is not None for x in asked):
            limits[f"{name}_limit"] = tuple(k if x is None else x for x, k in zip(asked, known, strict=True))
    return source, folder, dataclasses.replace(Options.for_profile(profile, **given), **limits)


def main(arguments: list[str] | None = None) -> None:
    source, folder, options = parsed(arguments)
    spark = ship(SparkSession.builder.appName("skillgraph").getOrCreate())
    write(spark, run(spark, source, options), folder, sampled=bool(options.subset_bytes or options.subset_rows))


if __name__ == "__main__":
    main()
