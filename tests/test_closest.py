"""Closest entities without a table of pairs: the same as ranks of all pairs."""

import random
from decimal import Decimal

import pytest

from skillgraph.operators import projection


def _edges(spark, kind, copies, seed=1):
    draw, rows = random.Random(seed), []
    for e in range(60):
        for f in draw.sample(range(12), draw.choice((1, 2, 4))):
            w = Decimal(draw.choice((5, 10, 15))) / draw.choice((1, 10))
            rows += [(kind(100 * c + e), f"f{f}", w) for c in range(copies)]
    return spark.createDataFrame(rows, f"entity {'long' if kind is int else 'string'}, feature string, weight decimal(18,6)")


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("copies", [1, 5])
@pytest.mark.parametrize("method,k,threshold", [("both", 3, 1.5), ("weighted", 4, 0.0), ("unweighted", 200, 0.0), ("both", 0, 2.0)])
def test_similar(spark, monkeypatch, kind, copies, method, k, threshold):
    monkeypatch.setattr(projection, "LISTED", 7)
    edges = _edges(spark, kind, copies)
    named = edges.withColumn("entity", edges.entity.cast("string"))
    want = projection.similarity(projection.pair_scores(named), method, k, threshold)
    found = projection.similar(edges, method, k, threshold)
    assert found.schema["entity"].dataType == edges.schema["entity"].dataType
    rows = lambda df: sorted((str(r["entity"]), str(r["neighbor"]), r["similarity_score"], r["rank"], r["method"]) for r in df.collect())
    assert rows(found) == rows(want)


def test_copies_are_compared_once(spark):
    """Two thousand entities of one kind would make four million pairs; their kind stands for them."""
    edges = spark.range(2_000).selectExpr("id as entity", "'f' as feature", "cast(1 as decimal(18,6)) as weight")
    plan = projection.similar(edges, "unweighted", 3)
    assert plan.count() == 6_000
    assert {r["neighbor"] for r in plan.where("entity = 0").collect()} == {1, 10, 100}


def test_large_weights_stay_decimals(spark):
    rows = [("a", "f", Decimal("999999999999.5")), ("b", "f", Decimal("999999999999.25")), ("c", "f", None)] + [(e, f"g{i}", Decimal("999999999999.999999")) for e in "ab" for i in range(20)]
    edges = spark.createDataFrame(rows, "entity string, feature string, weight decimal(18,6)")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(projection.similar(edges, "weighted", 5)) == rows(projection.similarity(projection.pair_scores(edges), "weighted", 5).select("entity", "neighbor", "similarity_score", "rank", "method"))


@pytest.mark.parametrize("kind", [int, str])
def test_pairs_are_dealt_by_their_number(spark, monkeypatch, kind):
    """More pairs than a task should hold go to more tasks than the session's shuffles have; they are those of a plain join."""
    monkeypatch.setattr(projection, "LISTED", 7)
    monkeypatch.setattr(projection, "PAIRS_AT_ONCE", 300)
    edges = _edges(spark, kind, 3)
    edges.createOrReplaceTempView("edges_of_pairs")
    found = projection.pair_scores(edges)
    assert found.rdd.getNumPartitions() > 4
    want = spark.sql("select x.entity, y.entity, count(*), sum(least(x.weight, y.weight)) from edges_of_pairs x join edges_of_pairs y on x.feature = y.feature and x.entity < y.entity group by 1, 2")
    assert found.schema["weighted_score"].dataType == want.schema[3].dataType
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_of_kinds_stand_for_all_pairs(spark):
    edges = _edges(spark, str, 4)
    pairs, members = projection.kind_pairs(edges)
    whole = projection.pair_scores(edges)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert pairs.count() * 4 < whole.count() == pairs.selectExpr("sum(n_pairs)").first()[0]
    each = projection.each_pair(pairs, members)
    assert rows(each.select(*whole.columns)) == rows(whole)
    for w in ("shared_count", "weighted_score"):
        ends = whole.selectExpr("a", w).union(whole.selectExpr("b", w))
        assert rows(projection.kind_degrees(pairs, members, w)) == rows(ends.groupBy("a").agg({"a": "count", w: "sum"}).selectExpr("a", "`count(a)`", f"`sum({w})`"))


def test_no_feature_is_too_large(spark):
    """Sixty thousand entities of one feature make more than a billion pairs; none is left out."""
    edges = spark.range(60_000).selectExpr("cast(id as string) as entity", "'f' as feature")
    assert [r["verdict"] for r in projection.guarded(edges, max_degree=None, max_pairs=0, max_total=0).collect()] == ["used"]


def test_pipeline_topk_has_no_limits(spark, monkeypatch):
    from types import SimpleNamespace

    from skillgraph.plans import registry

    seen = []
    monkeypatch.setattr(registry, "_made_file", lambda *_: "")
    monkeypatch.setattr(registry.pipeline, "run", lambda _, path, options: seen.append(options) or SimpleNamespace(topk=None))
    registry.pipeline_topk(spark, "")
    assert (seen[0].max_feature_degree, seen[0].max_pairs_per_feature, seen[0].max_total_pairs) == (None, 0, 0)


def test_pairs_of_numbers_are_no_rows(spark):
    """Numbered entities: pairs are added up and ranked as arrays, so no window sorts them and no row is made for each."""
    plan = projection.similar(_edges(spark, int, 1), "both", 3, 1.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "weighted_score" not in plan


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("listed", [7, 1_000])
def test_pairs_that_meet_once_cross_no_network(spark, monkeypatch, kind, listed):
    """Entities with two features each: only pairs that share both are added up. With edges that come twice every pair is."""
    monkeypatch.setattr(projection, "LISTED", listed)
    draw = random.Random(3)
    rows = [(kind(e), f"f{f:02d}", Decimal(draw.choice((5, 10, 15))) / 10) for e in range(300) for f in draw.sample(range(20), 2)]
    rows.append((kind(7), None, Decimal(1)))
    twice, seen = projection._twice, []
    monkeypatch.setattr(projection, "_twice", lambda *args: seen.append(twice(*args)) or seen[-1])
    for some in (rows, rows + rows[:1]):
        edges = spark.createDataFrame(some, f"entity {'long' if kind is int else 'string'}, feature string, weight decimal(18,6)")
        edges.createOrReplaceTempView("edges_that_meet")
        found = projection.pair_scores(edges)
        want = spark.sql("select x.entity as a, y.entity as b, count(*), sum(least(x.weight, y.weight)) from edges_that_meet x join edges_that_meet y on x.feature = y.feature and x.entity < y.entity group by 1, 2")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert found.schema["weighted_score"].dataType == want.schema[3].dataType
    assert 100 < seen[0].select("a", "b").distinct().count() < 543 and seen[1] is None
