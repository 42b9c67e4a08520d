import hashlib
import pytest
from pyspark.sql import functions as F

from skillgraph.config import Options
from skillgraph.functions import cells, text
from skillgraph.functions.cells import NO_ITEMS, NO_PARSE, parse_cells, split_query
from skillgraph.plans.pipeline import parsed
from skillgraph.sources.tabular import numbered


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  Problem\t Solving.;-", "problem solving"), (None, ""), ("C++", "c++"), ("a/b/", "a/b"), (" Été ", "été")])
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, text.normalize_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Mission-Critical", ("mission-critical", 4)), ("mission_critical", ("mission critical", 4)), ("4: Advanced", ("4: advanced", 3)), ("very advanced!", ("very advanced", 3)), ("Working  Knowledge", ("working knowledge", 1)), ("quite familiar", ("quite familiar", 0)), ("???", ("unknown", 0)), (None, ("unknown", 0)), ("other", ("other", 0))],
)
def test_bucket(spark, raw, want):
    assert tuple(one(spark, raw, text.bucket)) == want


def test_edge_weight(spark):
    rows = spark.createDataFrame([(4, 0.8), (4, None), (9, 1.5), (0, -1.0)], "b int, s double").select(text.edge_weight(F.col("b"), F.col("s")).alias("w")).collect()
    assert [r["w"] for r in rows] == [0.86, 0.75, 1.0, 0.0]


@pytest.mark.parametrize(("raw", "want"), [("1,250", 1250.0), (" 7.5 ", 7.5), ("about 5", None), (None, None), ("nan", None)])
def test_parse_number(spark, raw, want):
    assert one(spark, raw, text.parse_number) == want


def test_headers():
    assert text.header_names(["Job ID", "District/State", "Job-ID", "  Salary (INR) "]) == ["job_id", "district_state", "job_id_1", "salary_inr"]


def test_clean_and_ids(spark):
    assert one(spark, " None ", text.clean) is None
    assert one(spark, "acme", lambda c: text.hashed_id("skill", c)).startswith("skill::")
    assert one(spark, " ", lambda c: text.fallback_id(c, c, c, F.lit(3))) == "job_fallback::" + hashlib.sha1(b"row_3").hexdigest()[:20]


def test_salary_band(spark):
    assert [one(spark, v, text.salary_band) for v in ("9,999", "10000", "49999", "50000", None, "x")] == ["lt_10k", "10k_20k", "20k_50k", "ge_50k", "ge_50k", "unknown"]


CELLS = [
    ('[{"skill":"A","bucket":"Advanced","mapping_similarity":0.5}]', [("A", "Advanced", 0.5)], None),
    ("[{'skill':'A','bucket':None,'mapping_similarity':0.5}]", [("A", None, 0.5)], None),
    ('{"name":"B"}', [("B", None, None)], None),
    ('see [{"skill":"A"}] there', [("A", None, None)], None),
    ("x {'skill': 'A', bucket: Low, mapping_similarity: 0.25} y", [("A", "Low", 0.25)], None),
    ('[1, {"skill":"", "skill_name":"C", "mapping_similarity":"0.5"}]', [("C", None, 0.5)], None),
    ("“quoted”", [], NO_PARSE),
    ("[1, 2]", [], NO_ITEMS),
    ("[]", [], None),
    ("", [], None),
    ("nan", [], None),
    (None, [], None),
    ("[" * 5000, [], NO_PARSE),
]


def test_parse_cells(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "row_idx int, skills string")
    got = {r["row_idx"]: ([(i["text"], i["bucket"], i["similarity"]) for i in r["items"]], r["reason"]) for r in parse_cells(df).collect()}
    assert {i: got[i] for i in got} == {i: (c[1], c[2]) for i, c in enumerate(CELLS)}


def test_split_query():
    assert split_query("Python, SQL; python\n\n R ,") == ["Python", "SQL", "R"]


def test_numbered(spark):
    rows = numbered(spark.range(0, 1000, 1, 7)).collect()
    assert [r["_row_"] for r in sorted(rows, key=lambda r: r["id"])] == list(range(1000))


def test_options():
    assert Options.for_profile("quick").betweenness_limit is None
    assert Options.for_profile("nonsense", top_k="7", threshold="x").top_k == 7
    assert Options.for_profile("full").max_total_pairs == 70_000_000
    assert [Options.for_profile(None, directed=x).directed for x in (" Yes ", "off", 1, 0, True, None, "perhaps")] == [True, False, True, False, True, False, False]


def test_command_line_options():
    base = ["--input", "i", "--output-dir", "o"]
    assert parsed(base) == ("i", "o", Options.for_profile("balanced"))
    _, _, o = parsed([*base, "--subset-mode", "--similarity-method", "weighted", "--similarity-threshold", "0.5", "--projection-max-skill-degree", "9", "--compute-closeness-max-edges", "7", "--disable-betweenness", "--chunksize", "5", "--directed", "no"])
    assert (o.subset_bytes, o.method, o.threshold, o.max_feature_degree, o.closeness_limit, o.betweenness_limit, o.directed) == (100 << 20, "weighted", 0.5, 9, (30_000, 7), None, False)
    _, _, o = parsed([*base, "--subset-mode", "--subset-target-rows", "40", "--method", "unweighted", "--directed"])
    assert (o.subset_bytes, o.subset_rows, o.method, o.directed) == (None, 40, "unweighted", True)
    assert parsed([*base, "--subset-mode", "--subset-target-size-mb", "2"])[2].subset_bytes == 2 << 20


def test_similarity_that_is_missing(spark):
    assert one(spark, None, text.clip_similarity) is None
    assert [one(spark, v, text.clip_similarity) for v in ("NaN", "-2", "0.25", "7", "x")] == [None, 0.0, 0.25, 1.0, None]


def test_compact_json_drops_nan(spark):
    df = spark.createDataFrame([("NaN", float("nan"), 1.5, None)], "s string, x double, y double, z string")
    assert df.select(text.compact_json("s", "x", "y", "z")).first()[0] == '{"s":"NaN","y":1.5}'


def test_flat_cells_agree_with_plain_reading(spark):
    rows = ['[{"skill":"a","bucket":"b","mapping_similarity":0.5}]', '[{"skill":5.0,"bucket":true}]', '[{"skill":"","name":"n"},{"skill_name":" x "}]', '[{"skill":"a"}] tail', '[{"skill":"a]","mapping_similarity":"0.5"}]', '{"skill":"a"}', "[]", '[{"skill":"a",}]', '[{"skill":"a"}, 3]', '[{"skill":null,"name":"0"}]', '[{"skill":"a","mapping_similarity":NaN}]', '[{"skill":"a","tags":["x"]}]']
    rows += ['[{"skill":"a","level":3,"note":"x\\u00e9 y","must":true,"none":null,"Skill":"b","":""}]', '[{"skill":"a","part":{"of":[1.5,"x"]}}]', "[{'skill': 'a', 'level': 3, 'must': True, 5: 1.5}]", '[{"skill":"a","share":0.0001,"big":12345678.0}]']
    rows += ['[{"skill":"a","level":1,"level":2}]', '[{"skill":"a","mapping_similarity":Infinity,"x":-Infinity}]', '[{"skill":"a","mapping_similarity":-Infinity}]', '[{"skill":"a\\ud800","x\\ud800":"\\ud800"}, {"name":"b"}]', 'see {"skill": "a", "level": 3} there']
    got = {r["skills"]: ([tuple(i) for i in r["items"]], r["reason"]) for r in cells.parse_cells(spark.createDataFrame([(r,) for r in rows], "skills string")).collect()}
    assert got == {r: cells.parse_cell(r) for r in rows}


def test_columns_of_any_name(spark):
    names = ["_text_", "text", "skills", "a.b", "FLAT", "items", "c0", "_hard_", "easy"]
    df = spark.createDataFrame([("1", "2", '[{"skill":"s","x":1}]', "4", "5", "6", "7", "8", "9")], ", ".join(f"`{n}` string" for n in names))
    got = parse_cells(df)
    assert got.columns == [n for n in names if n != "items"] + ["items", "reason"]
    row = got.first()
    assert [row[i] for i in range(8)] == ["1", "2", '[{"skill":"s","x":1}]', "4", "5", "7", "8", "9"] and row["items"][0]["extra"] == {"x": "1"}


def test_white_space_of_any_script(spark):
    for raw in ("  A  b　", " \tA \x1f\n b\x1c", "A b", "é é ", "", "　"):
        assert one(spark, raw, text.strip) == raw.strip()
        assert one(spark, raw, text.normalize_text) == " ".join(raw.lower().split())


def test_faults_are_told_from_cells_that_are_read_once(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CELLS)], "row_idx int, skills string").repartition(2, "row_idx")
    found = cells.faults_of(parse_cells(df), "row_idx")
    assert {r["row_idx"]: r["reason"] for r in found.collect()} == {i: c[2] for i, c in enumerate(CELLS) if c[2]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1  # a plain filter on the reason has it dozens of times, below the parsing


def test_broken_cells_come_back_as_they_were_read(spark):
    rows = ["x {'skill': 'A', bucket: Low} y", "[{'skill': 'B', 'k': None, 'n': [1]}, {'name': 'C'}]", None, "order 7", "'[1]'", "7 [{'skill': 'D'}]"]
    got = parse_cells(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, skills string").coalesce(1)).collect()
    assert {r["i"]: ([tuple(i) for i in r["items"]], r["reason"]) for r in got} == {i: cells.parse_cell(r) if r else ([], None) for i, r in enumerate(rows)}
    assert [len(r["items"]) for r in sorted(got, key=lambda r: r["i"])] == [1, 2, 0, 0, 0, 1]


def test_cells_are_dealt_by_rows(spark, monkeypatch):
    from skillgraph.plans import registry

    monkeypatch.setattr(registry, "CELLS_AT_ONCE", 100)
    assert registry._dealt(spark.range(0, 1000, 1, 1), "id").rdd.getNumPartitions() == 10
