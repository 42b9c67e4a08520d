"""Jobs, skills and edges as node and edge tables with JSON attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgraph.functions.text import compact_json

# The attributes of each kind and their order.
JOB_ATTRIBUTES = ("company_name", "posted_at", "group", "assigned_occupation_group", "district", "industry", "nco_code", "salary_mean_inr_month")
SKILL_ATTRIBUTES = ("skill_text_normalized", "skill_text_raw_example")
EDGE_ATTRIBUTES = ("skill_text_raw", "skill_text_normalized", "bucket_raw", "bucket_normalized", "bucket_score", "mapping_similarity", "source_row_index")


def nodes_table(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """node_id, node_type, label, attributes_json."""
    job = jobs.select(F.col("job_id").alias("node_id"), F.lit("job").alias("node_type"), F.col("job_title").alias("label"), compact_json(*JOB_ATTRIBUTES).alias("attributes_json"))
    skill = skills.select(F.col("skill_id").alias("node_id"), F.lit("skill").alias("node_type"), "label", compact_json(*SKILL_ATTRIBUTES).alias("attributes_json"))
    return job.unionByName(skill)


def edges_table(edges: DataFrame) -> DataFrame:
    """source, target, relation, weight, attributes_json."""
    return edges.select(F.col("job_id").alias("source"), F.col("skill_id").alias("target"), F.lit("requires_skill").alias("relation"), F.col("edge_weight").cast("double").alias("weight"), compact_json(*EDGE_ATTRIBUTES).alias("attributes_json"))
