import pathlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from skillgraph.operators import entities, graph, paths, projection, subset
from skillgraph.operators.components import connected
from skillgraph.streaming import increments


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")]
    found = {r["node"]: r["component"] for r in connected(edges_of(spark, chain), spark.createDataFrame([("n000",), ("x",), ("z",)], "node string")).collect()}
    assert found == {"n000": "n000", "x": "x", "z": "z"}
    whole = {r["node"]: r["component"] for r in connected(edges_of(spark, chain)).collect()}
    assert set(whole.values()) == {"n000", "x"} and len(whole) == 63


def test_centrality_of_a_path(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    table, notes = paths.centrality(edges, nodes, (10, 10), (10, 10))
    rows = {r["node"]: (r["degree"], r["betweenness"], r["closeness"] and round(r["closeness"], 6)) for r in table.collect()}
    assert rows == {"a": (1, 0.0, 0.5), "b": (2, 2.0, 0.75), "c": (2, 2.0, 0.75), "d": (1, 0.0, 0.5), "e": (0, 0.0, None)}
    assert notes == {"betweenness": "computed", "closeness": "computed"}


def test_guards(spark):
    edges, nodes = edges_of(spark, [("a", "b")]), spark.createDataFrame([("a",), ("b",)], "node string")
    _, notes = paths.centrality(edges, nodes, (1, 9), None)
    assert notes == {"betweenness": "guarded_by_size(v=2,e=1,v_limit=1,e_limit=9)", "closeness": "disabled_by_config"}


@pytest.mark.parametrize("words,at_once", [(1, 1), (2, 1_000_000)])
def test_closeness_beyond_the_limits(spark, monkeypatch, words, at_once):
    """A graph too large to be broadcast has the same closeness: 70 vertices in a ring with chords, and a smaller component."""
    pairs = [(f"n{i:03d}", f"n{(i + 1) % 70:03d}") for i in range(70)] + [(f"n{i:03d}", f"n{i * 7 % 70:03d}") for i in range(1, 70, 3)] + [("x", "y"), ("y", "z")]
    edges = edges_of(spark, {(min(p), max(p)) for p in pairs if p[0] != p[1]})
    nodes = edges.selectExpr("explode(array(a, b)) as node").distinct()
    want = {r["node"]: r["closeness"] for r in paths.closeness(edges, nodes).collect()}
    monkeypatch.setattr(paths, "MOST", (1, 1))
    monkeypatch.setattr(paths, "WORDS", words)
    monkeypatch.setattr(paths, "ROWS_AT_ONCE", at_once)
    assert len(want) == 70 and {r["node"]: r["closeness"] for r in paths.closeness(edges, nodes).collect()} == want
    sums = {r["node"]: (r["distance_sum"], r["reached"]) for r in paths.distance_sums(edges_of(spark, [("x", "y"), ("y", "z"), ("p", "q")])).collect()}
    assert sums == {"x": (3, 3), "y": (2, 3), "z": (3, 3), "p": (1, 2), "q": (1, 2)}
    assert paths.closeness(edges.limit(0), nodes.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [200, 1_000_000])
def test_betweenness_beyond_the_limits(spark, monkeypatch, at_once):
    pairs = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)] + [("n00", "n05"), ("n02", "n09"), ("x", "y"), ("y", "z")]
    edges = edges_of(spark, {(min(p), max(p)) for p in pairs})
    nodes = edges.selectExpr("explode(array(a, b)) as node").distinct()
    rows = lambda: sorted((r["node"], r["degree"], round(r["betweenness"], 6)) for r in paths.betweenness(edges, nodes).collect())
    want = rows()
    monkeypatch.setattr(paths, "MOST", (1, 1))
    monkeypatch.setattr(paths, "ROWS_AT_ONCE", at_once)
    assert len(want) == 15 and ("y", 2, 1.0) in want and rows() == want
    assert paths.betweenness(edges.limit(0), nodes.limit(0)).count() == 0


def test_betweenness_of_a_square(spark):
    rows = {r["node"]: r["betweenness"] for r in paths.path_measures(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])).collect()}
    assert rows == {x: 0.5 for x in "abcd"}


def test_ego_clip_and_sample(spark):
    edges = edges_of(spark, combinations("abcde", 2))
    assert [(r["node"], r["hop"]) for r in graph.ego(edges, "c", 2, 3).orderBy("place").collect()] == [("c", 0), ("a", 1), ("b", 1)]
    assert graph.ego(edges, "zz", 2, 3).count() == 0
    nodes = spark.createDataFrame([(x, "job") for x in "abcde"], "node string, node_type string")
    table, kept, clipped = graph.rendered(edges, nodes, 3)
    assert (kept.count(), clipped) == (3, 7)
    assert {r["local_degree"] for r in table.collect()} == {4}
    many = spark.createDataFrame([(f"n{i:02d}", "job" if i % 2 else "skill") for i in range(20)], "node string, node_type string")
    full = edges_of(spark, [(f"n{i:02d}", f"n{j:02d}") for i, j in combinations(range(20), 2)])
    picks = [sorted(r["node"] for r in graph.sample_nodes(many, full, 8).collect()) for _ in range(2)]
    assert picks[0] == picks[1] and len(picks[0]) == 8


def test_projection_and_ties(spark):
    rows = [("a", "x", 2), ("b", "x", 1), ("c", "x", 3), ("a", "y", 5), ("b", "y", 4)]
    edges = spark.createDataFrame(rows, "entity string, feature string, weight int").withColumn("weight", F.col("weight").cast("decimal(18,6)"))
    pairs = projection.pair_scores(edges)
    assert {(r["a"], r["b"]): (r["shared_count"], float(r["weighted_score"])) for r in pairs.collect()} == {("a", "b"): (2, 5.0), ("a", "c"): (1, 2.0), ("b", "c"): (1, 1.0)}
    top = {(r["entity"], r["neighbor"]) for r in projection.closest(pairs, "shared_count", 1).collect()}
    assert top == {("a", "b"), ("b", "a"), ("c", "a")}
    assert projection.similarity(pairs, "both", 0, 2.0).count() == 6
    with pytest.raises(ValueError, match="unknown method"):
        projection.similarity(pairs, "none")


def test_total_limit_is_first_fit(spark):
    rows = [(f"e{i}", f) for f, n in (("f1", 4), ("f2", 9), ("f3", 3), ("f4", 1)) for i in range(n)]
    judged = projection.guarded(spark.createDataFrame(rows, "entity string, feature string"), max_total=10)
    assert {r["feature"]: r["verdict"] for r in judged.collect()} == {"f1": "used", "f2": "total", "f3": "used", "f4": "single"}


def test_edges_keep_the_earliest_best(spark):
    items = spark.createDataFrame([("a", "x", 1.0, 0, 0), ("a", "x", 3.0, 1, 0), ("a", "x", 3.0, 1, 1), ("a", "x", 3.0, 2, 0)], "e string, f string, w double, r int, p int")
    assert tuple(entities.best_edges(items, "e", "f", "w", ("r", "p")).first()) == ("a", "x", 3.0, 1, 0)
    assert entities.duplicate_edges(items, "e", "f", "w", "r", "p").first()[0] == 3


def test_quotas(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, n long")
    assert {r["stratum"]: r["quota"] for r in subset.quotas(counts, 4).collect()} == {"a": 2, "b": 1, "c": 1}
    assert {r["quota"] for r in subset.quotas(counts, 0).collect()} == {0}


def test_cutoffs(spark):
    freq = spark.createDataFrame([(i,) for i in [1] * 10 + [2] * 80 + [9] * 10], "n long")
    assert subset.frequency_cutoffs(freq) == (1, 2)
    assert subset.frequency_cutoffs(freq.limit(0)) == (1, 999_999_999)


def test_streamed_edges(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "entity string, feature string, weight double, row_idx long"
    for part in ([("a", "x", 1.0, 0), ("b", "x", 2.0, 1)], [("a", "x", 4.0, 2), ("b", "x", 2.0, 3)]):
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        assert increments.edge_stream(spark, source, df.schema, folder).awaitTermination(120)
    rows = {(r["entity"], r["weight"], r["row_idx"]) for r in increments.current_edges(spark, folder).collect()}
    assert rows == {("a", 4.0, 2), ("b", 2.0, 1)}


def test_a_batch_leaves_other_parts_alone(spark, tmp_path):
    folder, schema = str(tmp_path), "entity string, feature string, weight double, row_idx long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    every = [(f"e{i}", "x", 1.0, i) for i in range(40)]
    assert increments.current_edges(spark, folder) is None
    increments.apply_batch(batch(*every), folder, 0, 8)
    first = increments._parts(spark, folder, 0)
    written = {p: sorted((f.name, f.stat().st_mtime_ns) for f in pathlib.Path(p).iterdir()) for p in first.values()}
    assert set(first) == set(range(8))
    for number in (1, 1):  # run again: the same
        increments.apply_batch(batch(("e3", "x", 5.0, 99), ("e3", "x", 0.5, 98)), folder, number, 8)
    second = increments._parts(spark, folder, 1)
    assert [k for k in second if second[k] != first[k]] == [k for k in second if any(r["entity"] == "e3" for r in spark.read.parquet(second[k]).collect())]
    assert len({*second.values()} & {*first.values()}) == 7 and all(sorted((f.name, f.stat().st_mtime_ns) for f in pathlib.Path(p).iterdir()) == written[p] for p in first.values())
    increments.apply_batch(batch(("new", "y", 1.0, 100)), folder, 2, 8)
    assert increments._lists(spark, folder) == [1, 2]
    gone = {*first.values()} - {*second.values()}
    assert gone and not any(pathlib.Path(p).exists() for p in gone)
    found = {(r["entity"], r["feature"]): (r["weight"], r["row_idx"]) for r in increments.current_edges(spark, folder).collect()}
    assert found == {(e, f): (w, i) for e, f, w, i in every} | {("e3", "x"): (5.0, 99), ("new", "y"): (1.0, 100)}


def test_directed_degrees(spark):
    rows = {r["node"]: (r["degree"], r["in_degree"], r["out_degree"], r["strength"], r["in_strength"]) for r in graph.degrees(edges_of(spark, [("a", "b"), ("c", "b"), ("b", "a")]), spark.createDataFrame([(x,) for x in "abcd"], "node string"), directed=True).collect()}
    assert rows == {"a": (2, 1, 1, 2.0, 1.0), "b": (3, 2, 1, 3.0, 2.0), "c": (1, 0, 1, 1.0, 0.0), "d": (0, 0, 0, 0.0, 0.0)}


def test_searches_from_several_centers(spark):
    edges = edges_of(spark, [("h", f"n{i}") for i in range(6)] + [("n0", "m"), ("m", "k"), ("x", "y"), ("x", "x")])
    centers = spark.createDataFrame([("h",), ("m",), ("x",), ("nobody",), ("h",)], "center string")
    rows = sorted((r["center"], r["place"], r["node"], r["hop"]) for r in graph.egos(edges, centers, 2, 4).collect())
    assert rows == [("h", 1, "h", 0), ("h", 2, "n0", 1), ("h", 3, "n1", 1), ("h", 4, "n2", 1), ("m", 1, "m", 0), ("m", 2, "k", 1), ("m", 3, "n0", 1), ("m", 4, "h", 2), ("x", 1, "x", 0), ("x", 2, "y", 1)]
    nodes = spark.createDataFrame([(x, "job", x.upper()) for x in ("h", "m", "k", "x", "y", *[f"n{i}" for i in range(6)])], "node string, node_type string, label string")
    around, inside = graph.hub_networks(edges, nodes, centers, 1, 50, 2)
    assert around.count() == 7 + 3 + 2 and around.where("label <> upper(node)").count() == 0
    assert sorted((r["center"], r["a"], r["b"]) for r in inside.collect()) == [("h", "h", "n0"), ("h", "h", "n1"), ("m", "m", "k"), ("m", "n0", "m"), ("x", "x", "y")]


def test_path_measures_have_limits(spark):
    with pytest.raises(ValueError, match="guarded_by_size"):
        paths.path_measures(edges_of(spark, [("a", "b"), ("b", "c")]), limit=(2, 9))
    assert paths.path_measures(edges_of(spark, [("a", "b")]).limit(0)).count() == 0


def test_components_of_hubs_and_edges_in_many_tasks(spark, monkeypatch):
    from skillgraph.operators import components

    monkeypatch.setattr(components, "EDGES_AT_ONCE", 40)
    pairs = [("m", f"x{i}") for i in range(150)] + [(f"x{i}", f"y{i % 7}") for i in range(90)] + [(f"q{i}", f"q{i + 1}") for i in range(40)] + [("solo", "solo"), ("q0", None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    want = {x: root(x) for x in parent}
    plain = connected(edges_of(spark, [p for p in pairs if p[1] is not None]))
    assert {r["node"]: r["component"] for r in plain.collect()} == want and plain.count() == len(want)
    monkeypatch.setattr(components, "LOOKED_AT", 1)
    monkeypatch.setattr(components, "HUB", 20)
    seen = []
    find = components._hubs
    monkeypatch.setattr(components, "_hubs", lambda edges: seen.append(find(edges)) or seen[-1])
    split = connected(spark.createDataFrame(pairs + pairs, "a string, b string"), spark.createDataFrame([("m",), ("alone",), ("x3",), ("m",)], "node string"))
    assert {r["node"]: r["component"] for r in split.collect()} == {"m": want["m"], "x3": want["x3"], "alone": "alone"}
    assert any(h is not None and h.where("a = 'm'").count() == 1 for h in seen)
    # No more edges than so many meet in a task, whatever the session's number of shuffles.
    assert components._tasks(spark, 4_000) == 100


def test_duplicates_and_size_are_counted_in_one_sort(spark):
    rows = [(1, "a", 1.0, 0), (1, "a", 2.0, 1), (1, "a", 2.0, 2), (2, "a", 1.0, 0), (2, "b", 1.0, 1), (3, None, 1.0, 0), (3, None, 0.5, 1), (None, "a", 1.0, 0)]
    items = spark.createDataFrame([("e", *r) for r in rows], "entity string, row long, feature string, weight double, place int")
    want = 2 + (2 - 1) + (1 - 1) + (1 - 1)  # in a row: 2.0 again, 0.5 after 1.0; (e, a) in rows 1 and 2; (e, b); (e, null)
    found = entities.duplicate_edges(items, "entity", "feature", "weight", "row", "place")
    assert found.first()[0] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Sort [") == 1
    size = entities.graph_size(items.withColumn("entity", F.col("row")), "entity", "feature")
    assert tuple(size.first()) == (3, 2, 5)
    assert "REPARTITION_BY_NUM" in size._jdf.queryExecution().executedPlan().toString()
    assert tuple(entities.graph_size(items.limit(0), "row", "feature").first()) == (0, 0, 0)


def test_a_part_is_merged_in_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(increments, "ITEMS_AT_ONCE", 50)
    rows = [(f"e{i % 90}", f"f{i % 7}", float(i % 11), i) for i in range(900)]
    for number in (0, 1):
        increments.apply_batch(spark.createDataFrame(rows[number::2], "entity string, feature string, weight double, row_idx long"), str(tmp_path / "state"), number, parts=2)
    got = {(r["entity"], r["feature"]): (r["weight"], r["row_idx"]) for r in increments.current_edges(spark, str(tmp_path / "state")).collect()}
    want = {}
    for e, f, w, i in rows:
        if (e, f) not in want or w > want[e, f][0]:
            want[e, f] = (w, i)
    assert got == want
    assert len(list((tmp_path / "state" / "edges").glob("1-*/part=0/*.parquet"))) > 2


def test_diagnostics_join_edges_and_nodes_once(spark, monkeypatch):
    from skillgraph.operators import quality

    made = []
    keep = quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: made.append(name) or keep(df, name))
    nodes = spark.createDataFrame([("a", "job", "A"), ("b", "skill", "B"), ("c", "job", "C")], "node_id string, node_type string, label string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "source string, target string, weight double")
    found = {c["check"]: (c["status"], c["details"]) for c in quality.diagnostics(nodes, edges)}
    assert made == ["nodes", "links"] and found["components"] == ("ok", "largest has 2 nodes") and found["ego_network"] == ("ok", "2 nodes") and found["global_sample"] == ("ok", "3 nodes")
