import json
import os

import pytest

from skillgraph.config import Options
from skillgraph.operators import lookup, quality
from skillgraph.plans import pipeline
from skillgraph.sources import exports, tabular

HEADER = "Job ID,Job Title,Company,Posted At,City,Group,Category,Salary,Importance (JSON)\n"
ROWS = [
    'j1,Welder,Acme,2025-01-01,"Pune, IN",Metal,Trades,"20,000","[{""skill"":""Arc Welding."",""bucket"":""Mission-Critical"",""mapping_similarity"":0.9},{""skill"":""arc  welding"",""bucket"":""Advanced"",""mapping_similarity"":0.2}]"',
    "j2,Fitter,Bolt,2025-01-02,Pune,Metal,Trades,,\"[{'skill':'Pipe Fitting','bucket':'Proficient','mapping_similarity':0.5},{'skill':'Arc Welding','bucket':'critical','mapping_similarity':0.6}]\"",
    'j3,,Bolt,2025-01-02,Pune,Metal,Trades,1,"[{""skill"":""X""}]"',
    'j1,Welder II,Acme Ltd,,,,,,"[{""skill"":""ARC WELDING"",""bucket"":""Mission-Critical"",""mapping_similarity"":0.95}]"',
    ',Cook,Inn,2025-02-01,Goa,Food,Hotels,9000,"[{""skill"":""Baking"",""bucket"":""4: Advanced""}]"',
    'j5,Guard,Safe,2025-02-01,Goa,Security,Services,9000,no list here',
    'j6,Driver,Go,2025-02-01,Goa,Transport,Services,9000,',
    'j7,Too,many,cells,here,a,b,c,d,e',
]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "jobs.csv"
    path.write_text("﻿" + HEADER + "\n".join(ROWS) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def result(spark, source):
    return pipeline.run(spark, source)


def test_counts(result):
    s = result.summary
    assert (s["num_jobs"], s["num_skills"], s["num_edges"]) == (5, 3, 4)
    assert s["dedup_stats"] == {"duplicate_job_rows": 1, "duplicate_job_skill_edges": 2}
    assert s["parse_failure_count"] == 1
    assert result.validation == {"missing_required_fields": [], "validation_error_counts": {"missing_job_title": 1}, "total_rows": 7, "valid_rows": 6}
    assert s["density"] == round(4 / 15, 8)
    assert (s["num_components"], s["largest_component_size"]) == (4, 4)
    assert result.quality["all_passed"]


def test_first_row_wins_and_later_fill(result):
    job = result.jobs.where("job_id = 'j1'").first()
    assert (job["job_title"], job["company_name"], job["posted_at"], job["salary_mean_inr_month"]) == ("Welder", "Acme", "2025-01-01", 20000.0)


def test_best_edge(result):
    edge = result.edges.where("job_id = 'j1'").first()
    assert float(edge["edge_weight"]) == 0.965 and edge["source_row_index"] == 3


def test_closest(result):
    rows = {(r["job_id"], r["neighbor_job_id"], r["method"]): (r["similarity_score"], r["rank"]) for r in result.topk.collect()}
    assert rows == {("j1", "j2", "unweighted"): (1.0, 1), ("j2", "j1", "unweighted"): (1.0, 1), ("j1", "j2", "weighted"): (0.72, 1), ("j2", "j1", "weighted"): (0.72, 1)}


def test_measures(result):
    rows = {r["job_id"]: r for r in result.projected_metrics.collect()}
    assert rows["j1"]["closeness"] == 1.0 and rows["j6"]["closeness"] is None and rows["j1"]["betweenness"] == 0.0
    assert {r["node_id"]: r["degree"] for r in result.job_metrics.collect()}["j6"] == 0


def test_outputs_and_lookups(spark, result, tmp_path):
    pipeline.write(spark, result, str(tmp_path), sampled=True)
    assert sorted(os.listdir(tmp_path)) == sorted(f"sample_{n}" for n in exports.OUTPUTS.values())
    listed = exports.artifacts(spark, str(tmp_path), True).collect()
    assert [r["artifact_name"] for r in listed] == list(exports.OUTPUTS) and all(r["size_bytes"] > 0 for r in listed) and {r["mime_type"] for r in listed} == {"text/csv", "application/json"}
    assert exports.artifacts(spark, str(tmp_path)).count() == 0
    report = json.loads("".join(r[0] for r in spark.read.text(exports.output_path(str(tmp_path), "graph_summary", True)).collect()))
    assert report["num_jobs"] == 5
    read = lambda name, cols: exports.read_table(spark, exports.output_path(str(tmp_path), name, True), cols)
    nodes, edges = read("nodes", ("node_id", "node_type", "label", "attributes_json")), read("edges", ("source", "target", "weight", "attributes_json"))
    topk = read("job_similarity_topk", ("job_id", "neighbor_job_id", "similarity_score", "rank", "method")).withColumn("rank", tabular.F.col("rank").cast("int"))
    jobs, skills, links = exports.jobs_catalog(nodes), exports.skills_catalog(nodes), exports.edges_catalog(edges)
    assert lookup.resolve_job(jobs, title=" WELDER ")[::2] == ("j1", "resolved_by_exact_title")
    assert lookup.resolve_job(jobs, title="eld")[::2] == ("j1", "resolved_by_partial_title")
    assert lookup.resolve_job(jobs, title="er")[2] == "ambiguous_partial_title"
    assert lookup.resolve_job(jobs, job_id="zz", title="Welder")[2] == "job_id_not_found:zz"
    assert lookup.resolve_job(jobs, title="Wender")[2] == "title_not_found_fuzzy_suggestions"
    assert lookup.resolve_job(jobs)[2] == "no_query"
    near = lookup.closest_jobs(topk, jobs, "j1", "all", 5, links).collect()
    assert [(r["method"], r["neighbor_job_title"], r["shared_skill_count"], r["shared_skills_preview"]) for r in near] == [("unweighted", "Fitter", 1, "arc welding"), ("weighted", "Fitter", 1, "arc welding")]
    hits, missed = lookup.resolve_skills(["Arc Welding", "arc welding!", "Pipe Fiting", "zzz"], skills)
    assert [r["query"] for r in hits.collect()] == ["Arc Welding"]
    assert [(r["query"], r["suggestions"]) for r in missed.collect()] == [("Pipe Fiting", ["Pipe Fitting"]), ("zzz", [])]
    ids = [r["skill_id"] for r in skills.collect()]
    ranked = lookup.rank_for_skills(links, jobs, ids, 4).collect()
    assert [(r["job_id"][:2], r["matched_skill_count"], r["matched_ratio"], r["rank"]) for r in ranked][0] == ("j2", 2, 0.5, 1)
    assert [r["rank"] for r in lookup.rank_for_skills(links, jobs, ids, 4, 0).collect()] == [1, 2, 3]
    assert [r["skill_text_normalized"] for r in lookup.top_skills(links, jobs, skills, "j2").collect()] == ["arc welding", "pipe fitting"]
    assert {c["check"]: c["status"] for c in quality.diagnostics(nodes, links_table(edges))} == {k: "ok" for k in ("node_columns", "edge_columns", "null_node_ids", "null_endpoints", "endpoint_membership", "ego_network", "components", "global_sample")}
    with pytest.raises(ValueError, match="missing columns"):
        exports.require(nodes, ("nope",))


def links_table(edges):
    return edges.withColumn("weight", tabular.F.col("weight").cast("double"))


def test_subset_is_fixed(spark, source):
    runs = [pipeline.run(spark, source, Options(subset_bytes=500, method="weighted")) for _ in range(2)]
    assert runs[0].summary["subset"] == runs[1].summary["subset"] and 0 < runs[0].summary["subset"]["selected_rows"] < 7
    assert sorted(map(tuple, runs[0].edges.drop("first_seen").collect())) == sorted(map(tuple, runs[1].edges.drop("first_seen").collect()))


def test_inference_needs_lists(spark):
    df = spark.createDataFrame([("a", "plain"), ("b", "text")], "id string, note string")
    assert tabular.infer_cell_column(df, df.columns) is None


def test_no_job(spark, tmp_path):
    (tmp_path / "x.csv").write_text("job title,skills\n,\n")
    with pytest.raises(ValueError, match="no row"):
        pipeline.run(spark, str(tmp_path / "x.csv"))
