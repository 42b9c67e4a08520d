"""Writing of results, and reading them back with a check of their columns."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgraph.operators import graph

# The names of what a run writes.
OUTPUTS: dict[str, str] = {
    "nodes": "nodes.csv",
    "edges": "edges.csv",
    "job_similarity_topk": "job_similarity_topk.csv",
    "graph_summary": "graph_summary.json",
    "parse_errors": "parse_errors.csv",
    "job_node_metrics": "job_node_metrics.csv",
    "skill_node_metrics": "skill_node_metrics.csv",
    "projected_job_metrics": "projected_job_metrics.csv",
    "profiling": "profiling_summary.csv",
    "validation": "validation_report.json",
    "qa_report": "qa_report.json",
}


def output_path(folder: str, name: str, sampled: bool = False) -> str:
    return f"{folder.rstrip('/')}/{'sample_' if sampled else ''}{OUTPUTS[name]}"


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers: written side by side, at any size."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    """A small report, indented; through Spark, so that any store will do."""
    text = json.dumps(report, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A written table, all as text. ValueError names the columns it lacks."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return require(df, required)


def artifacts(spark: SparkSession, folder: str, sampled: bool = False) -> DataFrame:
    """(artifact_name, file_path, mime_type, size_bytes) of the outputs that a run has left in ``folder``, in the order in which they are named."""
    rows = []
    for name, file in OUTPUTS.items():
        path = output_path(folder, name, sampled)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(place):
            rows.append((name, path, "application/json" if file.endswith(".json") else "text/csv", store.getContentSummary(place).getLength()))
    return spark.createDataFrame(rows, "artifact_name string, file_path string, mime_type string, size_bytes long")


def require(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def attribute(name: str, column: str = "attributes_json") -> Any:
    """A field of the JSON attributes; NULL where they aren't JSON."""
    return F.get_json_object(F.col(column), f"$.{name}")


def graph_tables(nodes: DataFrame, edges: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, node_type, label) and (a, b, weight) of exported tables: of repeated nodes the first by ``order`` (without one, the least);
    a weight that isn't a number is 1; edges to unknown nodes or to themselves are left out. ValueError names lacking columns."""
    rows = require(nodes, ("node_id", "node_type", "label"))
    kept = F.struct(*([order] if order else []), F.col("node_type").cast("string").alias("node_type"), F.col("label").cast("string").alias("label"))
    known = rows.groupBy(F.col("node_id").cast("string").alias("node")).agg(F.min(kept).alias("_k")).select("node", "_k.node_type", "_k.label")
    weight = F.col("weight").cast("string").try_cast("double")
    links = require(edges, ("source", "target", "weight")).select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.coalesce(F.when(~F.isnan(weight), weight), F.lit(1.0)).alias("weight"))
    return known, graph.usable_edges(links, known).select("a", "b", "weight")


def jobs_catalog(nodes: DataFrame) -> DataFrame:
    """job_id, job_title, company_name, district, assigned_occupation_group, job_title_norm, company_name_norm of the job nodes."""
    jobs = require(nodes, ("node_id", "node_type", "label", "attributes_json")).where("node_type = 'job'")
    text = lambda n: F.coalesce(attribute(n), F.lit("")).alias(n)
    jobs = jobs.select(F.col("node_id").cast("string").alias("job_id"), F.coalesce("label", F.lit("")).alias("job_title"), text("company_name"), text("district"), text("assigned_occupation_group"))
    return jobs.withColumn("job_title_norm", F.lower(F.trim("job_title"))).withColumn("company_name_norm", F.lower(F.trim("company_name")))


def skills_catalog(nodes: DataFrame) -> DataFrame:
    """skill_id, label, skill_text_normalized of the skill nodes; one for each id, the least normalized text first."""
    skills = require(nodes, ("node_id", "node_type", "label", "attributes_json")).where("node_type = 'skill'")
    rows = skills.select(F.col("node_id").cast("string").alias("skill_id"), "label", F.coalesce(attribute("skill_text_normalized"), F.lower(F.trim("label"))).alias("skill_text_normalized")).where("length(skill_id) > 0")
    return rows.groupBy("skill_id").agg(F.min(F.struct("skill_text_normalized", "label")).alias("s")).select("skill_id", "s.label", "s.skill_text_normalized")


def edges_catalog(edges: DataFrame) -> DataFrame:
    """job_id, skill_id, edge_weight and the attributes of the edges with both ends; a weight that isn't a number is 0."""
    rows = require(edges, ("source", "target", "weight", "attributes_json"))
    return rows.select(
        F.col("source").cast("string").alias("job_id"), F.col("target").cast("string").alias("skill_id"), F.coalesce(F.col("weight").cast("string").try_cast("double"), F.lit(0.0)).alias("edge_weight"),
        F.coalesce(attribute("skill_text_normalized"), F.lit("")).alias("skill_text_normalized"), F.coalesce(attribute("bucket_normalized"), F.lit("")).alias("bucket_normalized"), attribute("mapping_similarity").try_cast("double").alias("mapping_similarity"),
    ).where("length(job_id) > 0 and length(skill_id) > 0")
