import random

import pytest

from skillgraph.operators import projection, subset
from skillgraph.plans import lookups, pipeline
from skillgraph.sources import exports, tabular
from tests.test_pipeline import HEADER, ROWS


def test_a_plain_file_is_split_and_numbered(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f'{i},"v ""{i}"""\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = tabular.read_csv(spark, str(tmp_path / "x.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["_row_"], r["a"], r["b"]) for r in rows) == [(i, str(i), f'v "{i}"') for i in range(3000)]


def test_cells_over_several_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [(r["a"], r["b"], r["_row_"]) for r in tabular.read_csv(spark, str(tmp_path / "x.csv")).orderBy("_row_").collect()] == [("1", "x\ny", 0), ("2", "z", 1)]


def test_files_in_order_of_their_paths(spark, tmp_path):
    """Spark reads the larger file first; the numbers follow the paths. A quote over lines keeps only its own file whole."""
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\n" + "".join(f"a{i},x\n" for i in range(3)))
    (folder / "b.csv").write_text("a,b\n" + "".join(f"b{i},x\n" if i % 5 else f"b{i},x,too many\n" for i in range(3000)))
    (folder / "c.csv").write_text('a,b\nc0,"two\nlines"\nc1\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = tabular.read_csv(spark, str(folder))
        rows = sorted((r["_row_"], r["a"], r["b"]) for r in read.collect())
        assert [len(x) for x in tabular._files(spark, str(folder))] == [2, 1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(3000) if i % 5] + ["c0", "c1"]
    assert [(n, a) for n, a, _ in rows] == list(enumerate(names)) and [b for *_, b in rows[-2:]] == ["two\nlines", None]


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n")
    read = tabular.read_csv(spark, str(tmp_path / "x.csv"))
    assert read.columns == ["a", "b", "_row_"] and read.count() == 0


def test_encoding_by_the_beginning(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("é,b\n1,2\n".encode("latin-1"))
    (tmp_path / "u.csv").write_text("é,b\n1,2\n", encoding="utf-8")
    assert [tabular.sniff_encoding(spark, str(tmp_path / n)) for n in ("l.csv", "u.csv")] == ["latin-1", "utf-8-sig"]
    assert tabular.sniff_encoding(spark, str(tmp_path)) == "latin-1"


@pytest.mark.parametrize("few", [100_000, 0, 5])
def test_first_fit(spark, few):
    draw = random.Random(3)
    sizes = [(i, f"f{i:03d}", draw.randrange(1, 40)) for i in range(200)]
    room, want = 700, set()
    for _, f, n in sizes:
        if n <= room:
            room -= n
            want.add(f)
    df = spark.createDataFrame(sizes, "first_seen int, f string, pairs long")
    assert {r["f"] for r in projection._first_fit(df, 700, few).collect()} == want


def test_strata(spark):
    columns = ("assigned_occupation_group", "group", "district", "salary_mean_inr_month")
    df = spark.createDataFrame([(" Trades ", "G", "PUNE", "20,000"), (" ", "Metal", None, "x"), ("unknown", " ", "Goa", None)], ", ".join(f"{c} string" for c in columns))
    key = lambda present: [r[0] for r in df.select(subset.stratum_key(frozenset(present))).collect()]
    assert key(columns) == ["trades||pune||20k_50k", "metal||nan||unknown", "unknown||goa||ge_50k"]
    assert key(columns[1:]) == ["g||pune||20k_50k", "metal||nan||unknown", "unknown||goa||ge_50k"]


def test_graph_tables(spark):
    nodes = spark.createDataFrame([("a", "job", "second", 2), ("a", "job", "first", 1), ("b", "skill", "x", 3)], "node_id string, node_type string, label string, at int")
    edges = spark.createDataFrame([("a", "b", "heavy"), ("a", "zz", "1"), ("a", "a", "1")], "source string, target string, weight string")
    known, links = exports.graph_tables(nodes, edges, "at")
    assert {r["node"]: r["label"] for r in known.collect()} == {"a": "first", "b": "x"}
    assert [tuple(r) for r in links.collect()] == [("a", "b", 1.0)]
    with pytest.raises(ValueError, match="weight"):
        exports.graph_tables(nodes, edges.drop("weight"))


def test_command_lines(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text(HEADER + "\n".join(ROWS) + "\n", encoding="utf-8")
    out = str(tmp_path / "out")
    pipeline.write(spark, pipeline.run(spark, str(tmp_path / "in.csv")), out)
    tables = {n: exports.output_path(out, n) for n in ("nodes", "edges", "job_similarity_topk")}
    closest = ["closest", "--nodes-csv", tables["nodes"], "--similarity-csv", tables["job_similarity_topk"]]
    skills = ["skills", "--nodes-csv", tables["nodes"], "--edges-csv", tables["edges"]]
    assert lookups.main([*closest, "--edges-csv", tables["edges"], "--title", "welder", "--json"]) == 0
    assert '"neighbor_job_id": "j2"' in capsys.readouterr().out
    assert lookups.main([*closest, "--job-id", "nobody"]) == 2
    assert "job_id_not_found" in capsys.readouterr().out
    assert lookups.main([*skills, "--skills", "arc welding, nothing"]) == 0
    printed = capsys.readouterr().out
    assert "job_id=j1" in printed and "query=nothing" in printed
    assert lookups.main([*skills, "--job-id", "j2"]) == 0 and lookups.main([*skills, "--skills", "nothing"]) == 2


def test_rates_of_many_rows_are_not_limited_in_one_task(spark, monkeypatch):
    from skillgraph.sources import tabular

    monkeypatch.setattr(tabular, "LIMITED_ROWS", 10)
    rows = [('[{"skill":"a"}]' if i < 20 else "x", None if i % 2 else ('{"bucket": 1}' if i < 40 else '"bucket": 1')) for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    limit, limits = type(df).limit, []
    monkeypatch.setattr(type(df), "limit", lambda self, n: limits.append(n) or limit(self, n))
    assert tabular.cell_rates(df, ["a", "b"], 60) == {"a": 20 / 60, "b": 1.0}
    assert tabular.cell_rates(df, ["a", "b"], 25) == {"a": 20 / 25, "b": 1.0}
    assert max(limits, default=0) <= 1  # first() alone
