"""Questions about the results: an entity by id or name, its closest ones, entities for features, features of an entity."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.functions.alike import common_length, indel_ratio, may_reach
from skillgraph.functions.text import normalize_text
from skillgraph.sources.tabular import numbered
from skillgraph.storage import stored

#: Unknown skills that are looked for in one reading of the catalog.
AT_ONCE = 16
#: Titles that a task compares.
TITLES_AT_ONCE = 50_000
CANDIDATE = ("job_id", "job_title", "company_name", "district")


def resolve_job(jobs: DataFrame, job_id: str | None = None, title: str | None = None, max_candidates: int = 10) -> tuple[str | None, DataFrame, str]:
    """(id or None, matching or suggested jobs, reason). An id that is missing doesn't fall back to the title."""
    none = jobs.select(*CANDIDATE).limit(0)
    if job_id:
        hit = jobs.where(F.col("job_id") == str(job_id))
        return (str(job_id), hit.limit(1), "resolved_by_job_id") if not hit.isEmpty() else (None, none, f"job_id_not_found:{job_id}")
    query = (title or "").strip().lower()
    if not query:
        return None, none, "no_query"
    for how, match in (("exact", F.col("job_title_norm") == query), ("partial", F.col("job_title_norm").contains(query))):
        hits = jobs.where(match).orderBy("job_id").limit(max(2, max_candidates))
        found = hits.select("job_id").take(2)
        if len(found) == 1:
            return found[0][0], hits, f"resolved_by_{how}_title"
        if found:
            return None, hits.select(*CANDIDATE).limit(max_candidates), f"ambiguous_{how}_title"
    near = close_titles(jobs, title.strip(), max_candidates)
    return (None, near, "title_not_found") if near.isEmpty() else (None, near.select(*CANDIDATE), "title_not_found_fuzzy_suggestions")


def close_titles(jobs: DataFrame, title: str, n: int, cutoff: float = 0.5) -> DataFrame:
    """Jobs whose title is one of the ``n`` most like ``title`` (sequence matching), of those at or over the cutoff.

    Titles that by length and letters can't reach the cutoff aren't matched, nor those that a task can tell to be behind its
    own ``n`` best: matching blocks are a common subsequence, so no longer than the longest one, which is found for many at once.
    """

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = difflib.SequenceMatcher()
        matcher.set_seq2(title)
        best: list[float] = []  # a heap
        for titles in batches:
            texts = titles.tolist()
            bounds = 2.0 * common_length(title, texts) / np.maximum(1, np.array([len(t) for t in texts], np.int64) + len(title))
            out = np.full(len(texts), np.nan)
            for i in np.argsort(-bounds, kind="stable"):
                if len(best) >= max(1, n) and bounds[i] < best[0]:
                    break
                matcher.set_seq1(texts[i])
                out[i] = matcher.ratio()
                (heapq.heappush if len(best) < max(1, n) else heapq.heappushpop)(best, out[i])
            yield pd.Series(out)

    titles = jobs.where(may_reach(F.col("job_title"), title, cutoff)).select("job_title").repartition(max(1, -(-jobs.count() // TITLES_AT_ONCE)), "job_title").distinct()
    best = titles.withColumn("like", ratio("job_title")).where(F.col("like").isNotNull() & ~F.isnan("like") & (F.col("like") >= cutoff)).orderBy(F.desc("like"), F.desc("job_title")).limit(max(0, n))
    return jobs.join(F.broadcast(stored(best, "titles")), "job_title").orderBy(F.desc("like"), "job_id").drop("like")


def closest_jobs(similarity: DataFrame, jobs: DataFrame, job_id: str, method: str = "unweighted", limit: int = 20, edges: DataFrame | None = None) -> DataFrame:
    """The closest jobs with both titles; with ``edges``, how many skills they share and five of them. Filters come before all joins."""
    own = similarity.where(F.col("job_id") == str(job_id))
    if method != "all":
        own = own.where(F.col("method") == method)
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("method").orderBy("rank", "neighbor_job_id"))).where(F.col("_n") <= max(0, limit)).drop("_n")
    me = jobs.select("job_id", F.col("job_title").alias("query_job_title"))
    other = jobs.select(F.col("job_id").alias("neighbor_job_id"), F.col("job_title").alias("neighbor_job_title"), F.col("company_name").alias("neighbor_company_name"))
    out = ranked.join(me, "job_id", "left").join(other, "neighbor_job_id", "left").select("job_id", "query_job_title", "neighbor_job_id", "neighbor_job_title", "neighbor_company_name", "similarity_score", "rank", "method")
    if edges is not None:
        shared = shared_features(edges, str(job_id), ranked.select("neighbor_job_id").distinct())
        out = out.join(shared, "neighbor_job_id", "left").withColumns({"shared_skill_count": F.coalesce("shared_skill_count", F.lit(0)), "shared_skills_preview": F.coalesce("shared_skills_preview", F.lit(""))})
    return out.orderBy("method", "rank", "neighbor_job_id")


def shared_features(edges: DataFrame, job_id: str, neighbors: DataFrame, shown: int = 5) -> DataFrame:
    """(neighbor_job_id, shared_skill_count, shared_skills_preview) by the texts of the skills."""
    named = edges.select("job_id", F.col("skill_text_normalized").alias("t")).where("length(t) > 0")
    mine = named.where(F.col("job_id") == job_id).select("t").distinct()
    theirs = named.withColumnRenamed("job_id", "neighbor_job_id").join(F.broadcast(neighbors), "neighbor_job_id", "left_semi").join(mine, "t", "left_semi")
    return theirs.groupBy("neighbor_job_id").agg(F.array_sort(F.collect_set("t")).alias("s")).select("neighbor_job_id", F.size("s").cast("long").alias("shared_skill_count"), F.array_join(F.slice("s", 1, shown), ", ").alias("shared_skills_preview"))


def resolve_skills(queries: list[str], skills: DataFrame, cutoff: float = 85.0, suggestions: int = 5) -> tuple[DataFrame, DataFrame]:
    """(query, skill_id, skill_text_normalized, label, match_type) of the queries that name a skill, and (query, query_normalized, suggestions) of the others.

    Of queries for one skill the first stays. Suggestions are the labels of the ``suggestions`` skills most like the query, of those
    at or over the cutoff. The catalog is read once for ``AT_ONCE`` queries; of its pairs with them, those that by length and
    letters can't reach the cutoff are left out before any text is compared.
    """
    spark = skills.sparkSession
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "place int, query string").withColumn("query_normalized", normalize_text(F.col("query"))).where("length(query_normalized) > 0")
    catalog = skills.groupBy("skill_text_normalized").agg(F.min(F.struct("skill_id", "label")).alias("s")).select("skill_text_normalized", "s.skill_id", "s.label")
    met = catalog.join(F.broadcast(asked), catalog["skill_text_normalized"] == asked["query_normalized"])
    hits = met.groupBy("skill_id").agg(F.min(F.struct("place", "query", "skill_text_normalized", "label")).alias("h")).select("h.place", "h.query", "skill_id", "h.skill_text_normalized", "h.label", F.lit("exact_normalized").alias("match_type"))
    missed = asked.join(met.select("place"), "place", "left_anti")

    open_ = [(r["place"], r["query_normalized"]) for r in missed.collect()]  # at most the queries
    name = F.col("skill_text_normalized")
    parts = []
    for k in range(0, len(open_), AT_ONCE):
        near = [F.when(may_reach(name, q, cutoff / 100), F.struct(F.lit(p).alias("place"), F.lit(q).alias("q"))) for p, q in open_[k : k + AT_ONCE]]
        parts.append(catalog.select("skill_text_normalized", "label", F.explode(F.array_compact(F.array(*near))).alias("x")))
    none = catalog.limit(0).select("skill_text_normalized", "label", F.struct(F.lit(0).alias("place"), F.lit("").alias("q")).alias("x"))
    scored = reduce(DataFrame.unionByName, parts, none).select("x.place", "label", "skill_text_normalized", indel_ratio("x.q", "skill_text_normalized").alias("score")).where(F.col("score") >= cutoff)
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "skill_text_normalized"))).where(F.col("n") <= max(1, suggestions))
    offered = top.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("suggestions"))
    return hits.orderBy("place").drop("place"), missed.join(offered, "place", "left").select("place", "query", "query_normalized", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions")).orderBy("place").drop("place")


def rank_for_skills(edges: DataFrame, jobs: DataFrame, skill_ids: list[str], total: int, limit: int = 20) -> DataFrame:
    """Jobs with any of the skills: by how many, then by summed weight, then by id."""
    hit = edges.where(F.col("skill_id").isin(*skill_ids))
    counted = hit.groupBy("job_id").agg(
        F.count_distinct("skill_id").alias("matched_skill_count"), F.round(F.sum(F.col("edge_weight").cast("decimal(18,6)")).cast("double"), 6).alias("matched_weight_sum"), F.array_join(F.array_sort(F.collect_set(F.when(F.trim("skill_text_normalized") != "", F.col("skill_text_normalized")))), ", ").alias("matched_skills")
    )
    order = [F.desc("matched_skill_count"), F.desc("matched_weight_sum"), "job_id"]
    if limit > 0:
        ranked = counted.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:  # all of them: numbered where they lie, after a sort by ranges
        ranked = numbered(counted.orderBy(*order), "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    titled = ranked.join(jobs.select("job_id", "job_title"), "job_id", "left")
    return titled.select("job_id", "job_title", "matched_skill_count", F.lit(total).alias("total_query_skills"), F.round(F.col("matched_skill_count") / F.lit(max(1, total)), 6).alias("matched_ratio"), "matched_weight_sum", "matched_skills", "rank").orderBy("rank")


def top_skills(edges: DataFrame, jobs: DataFrame, skills: DataFrame, job_id: str, limit: int = 20) -> DataFrame:
    """The heaviest skills of a job; a skill's text falls back to the catalog."""
    own = edges.where(F.col("job_id") == str(job_id)).join(skills.select("skill_id", "label", F.col("skill_text_normalized").alias("_known")), "skill_id", "left")
    own = own.withColumn("skill_text_normalized", F.when(F.trim("skill_text_normalized") != "", F.col("skill_text_normalized")).otherwise(F.col("_known")))
    order = [F.desc("edge_weight"), "skill_text_normalized", "skill_id"]
    best = own.orderBy(*order).limit(limit) if limit > 0 else own
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))
    return ranked.join(jobs.select("job_id", "job_title"), "job_id", "left").select("job_id", "job_title", "skill_id", "skill_text_normalized", F.col("label").alias("skill_label"), "edge_weight", "bucket_normalized", "mapping_similarity", "rank").orderBy("rank")


def linked_jobs(edges: DataFrame, jobs: DataFrame, skill_id: str, limit: int = 200) -> DataFrame:
    """(job_id, job_title) of the jobs that have a skill, by id."""
    return edges.where(F.col("skill_id") == skill_id).select("job_id").distinct().orderBy("job_id").limit(limit).join(jobs.select("job_id", "job_title"), "job_id", "left").orderBy("job_id")
