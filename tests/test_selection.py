"""Thresholds against a sort of each group."""

import random

import pytest
from pyspark.sql import functions as F

from skillgraph.operators.selection import best_of_each


@pytest.mark.parametrize("small", [0, 7, 50_000])
def test_best_of_each(spark, small):
    draw = random.Random(small)
    rows = []
    for group, n in (("a", 400), ("b", 90), ("one", 1), ("same", 60), (None, 5), ("no quota", 9)):
        for i in range(n):
            rows.append((group, 1.5 if group == "same" else draw.choice((draw.random(), 0.25, 1e6, -3.0)), i * 3 % 50, f"r{len(rows):04d}"))
    quotas = {"a": 137, "b": 90, "one": 5, "same": 13, "absent": 4, "no quota": 0}
    df = spark.createDataFrame(rows, "g string, x double, y long, name string")
    found = best_of_each(df, spark.createDataFrame(list(quotas.items()), "g string, quota long"), "g", ("x", "y"), (F.asc("name"),), small)
    assert found.columns == df.columns
    expected = [r for g, n in quotas.items() for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], -r[2], r[3]))[:n]]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert best_of_each(df.limit(0), spark.createDataFrame([], "g string, quota long"), "g", ("x",), (), small).count() == 0
