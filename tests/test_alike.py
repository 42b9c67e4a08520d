"""Fuzzy lookups against plain loops over the whole catalog."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from skillgraph.functions.alike import common_length, may_reach
from skillgraph.operators import lookup


def plain_ratio(a, b):
    """By the full table of prefixes."""
    if not a and not b:
        return 100.0
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return 200.0 * table[-1][-1] / (len(a) + len(b))


def words(seed, n, letters="abcdé 😀", longest=12):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(longest + 1))) for _ in range(n)]


@pytest.mark.parametrize("length", [0, 1, 7, 62, 63, 200])
def test_common_length(length):
    query = "".join(words(length, 1 + length, longest=9))[:length]
    texts = words(5, 200, longest=40) + [query, query[::-1], "", query + "x"]
    expected = [round(plain_ratio(query, t) * (len(query) + len(t)) / 200) if query or t else 0 for t in texts]
    assert common_length(query, texts).tolist() == expected and common_length(query, []).tolist() == []


def test_bounds_leave_nothing_out(spark):
    texts = spark.createDataFrame([(t,) for t in words(1, 400)] + [(None,)], "t string")
    for query in (*words(2, 6), "abc"):
        for share in (0.5, 0.85):
            kept = {r[0] for r in texts.where(may_reach(F.col("t"), query, share)).collect()}
            for t in (r[0] for r in texts.collect()):
                if t is not None and (plain_ratio(query, t) >= 100 * share or difflib.SequenceMatcher(None, t, query).ratio() >= share):
                    assert t in kept


@pytest.mark.parametrize("cutoff", [85.0, 60.0, 0.0])
def test_suggestions(spark, cutoff):
    catalog = sorted({t.strip() for t in words(7, 500, "abcde ", 14)} - {""})
    skills = spark.createDataFrame([(f"s{i}", t, t.upper()) for i, t in enumerate(catalog)], "skill_id string, skill_text_normalized string, label string")
    queries = [f"{t}q" for t in catalog[::23]] + [catalog[0], "zzz zz"]
    hits, missed = lookup.resolve_skills(queries, skills, cutoff, 4)
    assert [r["query"] for r in hits.collect()] == [catalog[0]]
    found = {r["query_normalized"]: r["suggestions"] for r in missed.collect()}
    assert len(found) > lookup.AT_ONCE
    for q, suggested in found.items():
        best = sorted(((-plain_ratio(q, t), t) for t in catalog))[:4]
        assert suggested == [t.upper() for score, t in best if -score >= cutoff]


def test_close_titles(spark):
    titles = sorted({t for t in words(11, 300, "abcdef ", 16)} - {""})
    jobs = spark.createDataFrame([(f"j{i}", t, "", "", t.lower().strip(), "") for i, t in enumerate(titles)] + [("none", None, "", "", None, "")], "job_id string, job_title string, company_name string, district string, job_title_norm string, company_name_norm string")
    for query in ("abcdefa", "Cab fed", "zzz", "a"):
        expected = difflib.get_close_matches(query, titles, 5, 0.5)
        at = {t: f"j{i}" for i, t in enumerate(titles)}
        expected.sort(key=lambda t: (-difflib.SequenceMatcher(None, t, query).ratio(), at[t]))  # jobs of equal titles by id
        assert [r["job_title"] for r in lookup.close_titles(jobs, query, 5).collect()] == expected


def test_close_titles_leave_out_what_is_behind_the_best(spark, monkeypatch):
    from skillgraph.operators import lookup

    titles = [f"Customer#{i:09d}" for i in range(3_000)]
    title = "Costumer#00000042x"
    want = sorted(((difflib.SequenceMatcher(None, t, title).ratio(), t) for t in titles), reverse=True)[:4]
    jobs = spark.createDataFrame([(t, t) for t in titles], "job_id string, job_title string")
    assert [r["job_title"] for r in lookup.close_titles(jobs, title, 4).collect()] == [t for _, t in sorted(want, key=lambda x: (-x[0], x[1]))]
    monkeypatch.setattr(lookup, "TITLES_AT_ONCE", 1_000)
    assert lookup.close_titles(jobs, title, 4).count() == 4 and lookup.close_titles(jobs, title, 0).count() == 0
