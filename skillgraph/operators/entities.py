"""Entities, features and weighted edges from parsed rows, with counters of what was dropped or merged."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.functions.cells import items_of, parse_cells
from skillgraph.functions.text import bucket, clean, clip_similarity, edge_weight, fallback_id, hashed_id, normalize_text, parse_number, pretty_label
from skillgraph.sources.tabular import Canonical
from skillgraph.storage import stored, tasks_for

WEIGHT = "decimal(18,6)"
#: Items that a task sorts or tells apart.
ITEMS_AT_ONCE = 1_000_000


def best_edges(items: DataFrame, entity: str, feature: str, weight: str, order: tuple[str, ...], keep: tuple[str, ...] = (), dealt: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each (entity, feature): the greatest weight, of equal ones the earliest by ``order``.

    ``dealt``: columns that follow from these two, by which the items are dealt out already. A minimum of structs, so that it is summed before the shuffle.
    """
    best = F.min(F.struct((-F.col(weight)).alias("_w"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)]))
    grouped = items.groupBy(entity, feature, *dealt).agg(best.alias("_b"))
    return grouped.select(entity, feature, *dealt, (-F.col("_b._w")).cast(items.schema[weight].dataType).alias(weight), *[F.col(f"_b._o{i}").alias(o) for i, o in enumerate(order)], *[F.col(f"_b._k{i}").alias(k) for i, k in enumerate(keep)])


def duplicate_edges(items: DataFrame, entity: str, feature: str, weight: str, row: str, place: str) -> DataFrame:
    """One row, duplicate_edges: items of a row no better than one before them there, and further rows of an edge."""
    own = items.select(F.col(entity).alias("e"), F.col(feature).alias("f"), F.col(row).alias("r"), F.col(place).alias("p"), F.col(weight).alias("w"))
    dealt = own.repartition(tasks_for(items.sparkSession, items.count(), ITEMS_AT_ONCE), "e", "f")
    in_row, in_edge = Window.partitionBy("e", "f", "r").orderBy("p"), Window.partitionBy("e", "f").orderBy("r", "p")  # one sort for both
    seen = dealt.select("r", "w", F.max("w").over(in_row.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.row_number().over(in_row).alias("i"), F.row_number().over(in_edge).alias("j"))
    again = F.count_if(F.col("m") >= F.col("w")) + F.count_if((F.col("i") == 1) & F.col("r").isNotNull()) - F.count_if(F.col("j") == 1)
    return seen.agg(again.cast("long").alias("duplicate_edges"))


def graph_size(items: DataFrame, entity: str, feature: str) -> DataFrame:
    """One row, entities, features and edges: how many different ones. Edges are told apart where all items of an entity are."""
    n = tasks_for(items.sparkSession, items.count(), ITEMS_AT_ONCE)
    own = items.select(F.col(entity).alias("e"), F.col(feature).alias("f")).repartition(n, "e")
    edges = own.groupBy("e", "f").agg(F.lit(1)).groupBy("e").agg(F.count("*").alias("n")).agg(F.count("e").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    features = own.select("f").distinct().agg(F.count("f").alias("features"))
    return edges.crossJoin(features).select("entities", "features", "edges")


def first_known(rows: DataFrame, key: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """One row for each key: of every column, the first value by ``order`` that isn't NULL; first_order and n_rows beside."""
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*known, F.min(order).alias("first_order"), F.count("*").alias("n_rows"))


def feature_catalog(items: DataFrame, feature: str, text: str, order: tuple[str, ...]) -> DataFrame:
    """One row for each feature, with the text of its first item by ``order``."""
    return items.groupBy(feature).agg(F.min_by(text, F.struct(*order)).alias("example"))


@dataclass(frozen=True)
class Built:
    jobs: DataFrame
    skills: DataFrame
    edges: DataFrame
    errors: DataFrame
    counters: DataFrame  # counter, n


JOB_TEXTS = ("job_title", "company_name", "posted_at", "group", "assigned_occupation_group", "district", "industry", "nco_code")


def build(source: Canonical, default_similarity: float = 0.5) -> Built:
    """Jobs, skills and edges of canonical rows. A blank cell, and one that can't be parsed, keeps its job without edges; a cell of spaces, or no cell column at all, drops the row."""
    cell = F.col("skills")
    skills_there = "skills" in source.present
    lacking = (F.length(F.trim(cell)) == 0) if skills_there else F.lit(True)
    rows = source.rows.withColumn("_title", clean(F.col("job_title"))).withColumn(
        "fault", F.when(F.col("_title").isNull(), "missing_job_title").when(F.coalesce(lacking, F.lit(False)), "missing_skills")
    )
    parsed = stored(parse_cells(rows.where("fault is null")), "parsed")
    bad = F.col("reason").isNotNull()
    errors = parsed.where(bad).select(F.col("row_idx").alias("row_id"), "reason", F.substring("skills", 1, 500).alias("raw_skills_snippet"))
    good = parsed.withColumn("job_id", F.coalesce(clean(F.col("job_id")), fallback_id(F.col("_title"), F.col("company_name"), F.col("posted_at"), F.col("row_idx"))))
    texts = [clean(F.col(c)).alias(c) for c in JOB_TEXTS]
    jobs = first_known(good.select("job_id", "row_idx", *texts, parse_number(F.col("salary_mean_inr_month")).alias("salary_mean_inr_month")), "job_id", "row_idx", (*JOB_TEXTS, "salary_mean_inr_month"))
    items = items_of(good, "job_id", "row_idx").select("job_id", "row_idx", "place", F.col("item.text").alias("skill_text_raw"), F.col("item.bucket").alias("bucket_raw"), clip_similarity(F.col("item.similarity")).alias("mapping_similarity"))
    items = items.withColumn("skill_text_normalized", normalize_text(F.col("skill_text_raw"))).where("length(skill_text_normalized) > 0").withColumn("_b", bucket(F.col("bucket_raw")))
    items = items.withColumns({"bucket_score": F.col("_b.score"), "bucket_normalized": F.col("_b.text"), "skill_id": hashed_id("skill", F.col("skill_text_normalized"))}).drop("_b")
    items = items.withColumn("edge_weight", edge_weight(F.col("bucket_score"), F.col("mapping_similarity"), default_similarity).cast(WEIGHT))
    kept = ("skill_text_raw", "skill_text_normalized", "bucket_raw", "bucket_score", "bucket_normalized", "mapping_similarity")
    edges = best_edges(items, "job_id", "skill_id", "edge_weight", ("row_idx", "place"), kept).withColumnRenamed("row_idx", "source_row_index").drop("place")
    seen = items.groupBy("job_id", "skill_id").agg(F.min(F.struct("row_idx", "place")).alias("first_seen"))
    edges = edges.join(seen, ["job_id", "skill_id"])
    of_row = best_edges(items, "row_idx", "skill_id", "edge_weight", ("place",), ("skill_text_raw", "skill_text_normalized"))
    skills = of_row.groupBy("skill_id").agg(F.min("skill_text_normalized").alias("skill_text_normalized"), F.min_by("skill_text_raw", "row_idx").alias("skill_text_raw_example"))
    skills = skills.withColumn("label", pretty_label(F.col("skill_text_normalized")))
    total = rows.agg(F.count("*").alias("total_rows"), F.count_if(F.col("fault") == "missing_job_title").alias("missing_job_title"), F.count_if(F.col("fault") == "missing_skills").alias("missing_skills"))
    valid = parsed.agg(F.count("*").alias("valid_rows"), F.count_if(bad).alias("parse_failure_count"))
    again = jobs.agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("duplicate_job_rows"))
    double = duplicate_edges(items, "job_id", "skill_id", "edge_weight", "row_idx", "place").withColumnRenamed("duplicate_edges", "duplicate_job_skill_edges")
    counters = reduce(DataFrame.unionByName, [c.unpivot([], c.columns, "counter", "n").withColumn("n", F.col("n").cast("long")) for c in (total, valid, again, double)])
    return Built(jobs, skills, edges, errors, counters)
