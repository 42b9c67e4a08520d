"""Command lines over exported tables: closest jobs (``closest``), and jobs for skills or skills of a job (``skills``)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgraph.functions.cells import split_query
from skillgraph.operators import lookup
from skillgraph.shipping import ship
from skillgraph.sources import exports

NOT_RESOLVED = 2


def _arguments(arguments: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Questions about exported tables")
    which = p.add_subparsers(dest="what", required=True)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("--nodes-csv", required=True)
    both.add_argument("--limit", type=int, default=20)
    both.add_argument("--max-candidates", type=int, default=10)
    both.add_argument("--json", action="store_true")
    near = which.add_parser("closest", parents=[both])
    near.add_argument("--similarity-csv", required=True)
    near.add_argument("--edges-csv")
    near.add_argument("--method", choices=("all", "weighted", "unweighted"), default="unweighted")
    skills = which.add_parser("skills", parents=[both])
    skills.add_argument("--edges-csv", required=True)
    skills.add_argument("--fuzzy-cutoff", type=float, default=85)
    skills.add_argument("--suggestion-limit", type=int, default=5)
    for parser in (near, skills):
        query = parser.add_mutually_exclusive_group(required=True)
        query.add_argument("--job-id")
        query.add_argument("--title")
        if parser is skills:
            query.add_argument("--skills")
    return p.parse_args(arguments)


def _records(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]  # at most the limit


def _show(records: list[dict], as_json: bool) -> None:
    if as_json:
        print(json.dumps(records, indent=2, default=str))
        return
    for r in records:
        print("  ".join(f"{k}={v}" for k, v in r.items()))


def _job(given: argparse.Namespace, jobs: DataFrame) -> str | None:
    job_id, rows, reason = lookup.resolve_job(jobs, given.job_id, given.title, given.max_candidates)
    if job_id is None:
        print(f"not resolved: {reason}")
        _show(_records(rows), False)
    return job_id


def main(arguments: list[str] | None = None) -> int:
    """Prints the answer; returns 0, or 2 if the query names no job or skill."""
    given = _arguments(arguments)
    spark = ship(SparkSession.builder.appName("skillgraph-lookup").getOrCreate())
    nodes = exports.read_table(spark, given.nodes_csv, ("node_id", "node_type", "label", "attributes_json"))
    edges = exports.edges_catalog(exports.read_table(spark, given.edges_csv, ("source", "target", "weight", "attributes_json"))) if given.edges_csv else None
    jobs = exports.jobs_catalog(nodes)
    if given.what == "closest":
        job_id = _job(given, jobs)
        if job_id is None:
            return NOT_RESOLVED
        similarity = exports.read_table(spark, given.similarity_csv, ("job_id", "neighbor_job_id", "similarity_score", "rank", "method")).withColumns({"rank": F.col("rank").cast("int"), "similarity_score": F.col("similarity_score").cast("double")})
        _show(_records(lookup.closest_jobs(similarity, jobs, job_id, given.method, given.limit, edges)), given.json)
        return 0
    catalog = exports.skills_catalog(nodes)
    if not given.skills:
        job_id = _job(given, jobs)
        if job_id is None:
            return NOT_RESOLVED
        _show(_records(lookup.top_skills(edges, jobs, catalog, job_id, given.limit)), given.json)
        return 0
    queries = split_query(given.skills)
    hits, missed = (_records(df) for df in lookup.resolve_skills(queries, catalog, given.fuzzy_cutoff, given.suggestion_limit))
    results = _records(lookup.rank_for_skills(edges, jobs, [h["skill_id"] for h in hits], len(queries), given.limit)) if hits else []
    if given.json:
        print(json.dumps({"resolved_skills": hits, "unresolved_skills": missed, "suggestions": {m["query"]: m["suggestions"] for m in missed}, "results": results}, indent=2, default=str))
    else:
        for name, records in (("resolved", hits), ("unresolved", missed), ("jobs", results)):
            print(f"{name}:")
            _show(records, False)
    return 0 if hits else NOT_RESOLVED


if __name__ == "__main__":
    sys.exit(main())
