"""A fixed stratified part of the rows: quotas by stratum, then the best rows of each by a score."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.functions.cells import parse_cells
from skillgraph.functions.text import normalize_text, salary_band, strip, unit_hash
from skillgraph.operators.selection import best_of_each
from skillgraph.sources.tabular import Canonical
from skillgraph.storage import stored


def quotas(counts: DataFrame, target: int, stratum: str = "stratum", n: str = "n") -> DataFrame:
    """``counts`` with quota: shares of ``target`` by largest remainder, ties by the larger and then the last stratum.

    The remainders are fewer than the strata; ranking them is the only step over all strata at once.
    """
    total = F.lit(counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0])
    exact = (F.col(n) / total) * F.lit(target)
    shared = counts.withColumn("_exact", F.when(total > 0, exact).otherwise(0.0)).withColumn("quota", F.floor("_exact").cast("long"))
    left = max(0, target - (shared.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]))
    more = shared.orderBy(F.desc(F.col("_exact") - F.col("quota")), F.desc(n), F.desc(stratum)).limit(left if total is not None and target > 0 else 0).select(stratum, F.lit(1).alias("_more"))
    return shared.join(more, stratum, "left").withColumn("quota", F.col("quota") + F.coalesce("_more", F.lit(0))).drop("_exact", "_more")


def frequency_cutoffs(frequencies: DataFrame, n: str = "n") -> tuple[int, int]:
    """(rare, common): the frequencies at a tenth and at nine tenths of all features in order; (1, 999999999) without any.

    Frequencies repeat: their histogram, not the features, is put in order.
    """
    histogram = frequencies.groupBy(n).agg(F.count("*").alias("m"))
    total = histogram.agg(F.sum("m")).first()[0]
    if not total:
        return 1, 999_999_999
    running = histogram.withColumn("upto", F.sum("m").over(Window.orderBy(n)))
    at = [max(1, int(total * q)) for q in (0.1, 0.9)]
    row = running.agg(*[F.min(F.when(F.col("upto") >= p, F.col(n))) for p in at]).first()
    return max(1, row[0]), max(1, row[1])


def row_size(columns: list[str], present: frozenset[str] | None = None) -> Column:
    """The estimated length of a row as text: blank cells count as ``nan``, absent columns as nothing, and one for each comma."""
    parts = [F.length(F.coalesce(F.col(c), F.lit("nan"))) for c in columns if present is None or c in present]
    total = F.lit(max(1, len(columns) - 1))
    for p in parts:
        total = total + p
    return total


def stratum_key(present: frozenset[str]) -> Column:
    """occupation||district||salary band, in lower case; the group stands for an occupation that is blank, unknown or no column."""

    def text(name: str) -> Column:
        if name not in present:
            return F.lit("unknown")
        value = F.lower(strip(F.coalesce(F.col(name), F.lit("nan"))))
        return F.when(value == "", "unknown").otherwise(value)

    named = text("assigned_occupation_group")
    occupation = F.when(named == "unknown", text("group")).otherwise(named)
    return F.concat_ws("||", occupation, text("district"), salary_band(F.col("salary_mean_inr_month"), "salary_mean_inr_month" in present))


def choose(rows: DataFrame, with_quota: DataFrame, target: int, stratum: str = "stratum", score: str = "score", row: str = "row_idx") -> DataFrame:
    """Of each stratum the best rows by (score, row) within its quota; if that is short of ``target``, the best of the rest."""
    chosen = stored(best_of_each(rows.select(stratum, row, score), with_quota, stratum, (score, row)).select(row, stratum), "chosen")
    short = target - chosen.count()
    if short <= 0:
        return chosen
    rest = rows.join(chosen.select(row), row, "left_anti").orderBy(F.desc(score), F.desc(row)).limit(short)
    return chosen.unionByName(rest.select(row, stratum))


def strata_counts(rows: DataFrame, chosen: DataFrame, stratum: str = "stratum") -> DataFrame:
    """(stratum, total_rows, selected_rows): how many rows of each stratum there are, and how many were chosen."""
    marked = rows.select(stratum, F.lit(1).alias("_all_"), F.lit(0).alias("_chosen_")).unionByName(chosen.select(stratum, F.lit(0).alias("_all_"), F.lit(1).alias("_chosen_")))
    return marked.groupBy(stratum).agg(F.sum("_all_").alias("total_rows"), F.sum("_chosen_").alias("selected_rows"))


def stratified_subset(source: Canonical, target_bytes: int, seed: int = 42, target_rows: int | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """(canonical rows of the subset in file order, summary): ``target_rows`` of them, or as many as make ``target_bytes``. The same rows for the same file and seed."""
    columns = [c for c in source.rows.columns if c != "row_idx"]
    parsed = parse_cells(source.rows)
    names = F.array_distinct(F.filter(F.transform("items", lambda i: normalize_text(i["text"])), lambda t: F.length(t) > 0))
    rows = stored(parsed.select("row_idx", stratum_key(source.present).alias("stratum"), row_size(columns, source.present).alias("size"), names.alias("skills")), "profile")
    total, average = rows.agg(F.count("*"), F.avg("size")).first()
    if not total:
        return source.rows, {"seed": seed, "total_rows": 0, "selected_rows": 0}
    target = min(total, max(1, int(target_rows or target_bytes // max(1.0, average))))
    share = quotas(rows.groupBy("stratum").agg(F.count("*").alias("n")), target)
    frequency = stored(rows.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n")), "frequency")
    rare, common = frequency_cutoffs(frequency)
    marks = rows.select("row_idx", F.explode("skills").alias("skill")).join(frequency, "skill").groupBy("row_idx").agg(F.max((F.col("n") <= rare).cast("int")).alias("rare"), F.max((F.col("n") >= common).cast("int")).alias("common"))
    score = unit_hash(seed, F.col("row_idx")) + 0.3 * F.coalesce("rare", F.lit(0)) + 0.1 * F.coalesce("common", F.lit(0)) + F.least(F.size("skills"), F.lit(20)) / 100.0
    chosen = stored(choose(rows.join(marks, "row_idx", "left").withColumn("score", score), share, target), "subset")
    strata = strata_counts(rows, chosen).agg(F.count("*"), F.count_if(F.col("selected_rows") > 0)).first()
    summary = {"seed": seed, "total_rows": total, "selected_rows": chosen.count(), "target_rows": target, "target_bytes": target_bytes, "average_row_bytes": round(average, 4), "rare_cutoff": rare, "common_cutoff": common, "strata": strata[0], "selected_strata": strata[1]}
    return source.rows.join(chosen.select("row_idx"), "row_idx", "left_semi").orderBy("row_idx"), summary
