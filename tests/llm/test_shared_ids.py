"""Rows of one id, or of none, with other texts: each is judged by its own text."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from skillgraph.llm import decontamination, line_dedup, simhash, substring_dedup
from tests.llm.helpers import documents, plain_words, prose, spaced_words
from tests.llm.test_near_duplicates import fingerprint, shingles

LONG, SHORT, ITEM = prose(800, 90), prose(801, 50), prose(802, 14)


def rows_of(*texts):
    """Each text under ids that others have too."""
    return [(i, t) for t in texts for i in (1, None)]


def test_substring_dedup(spark):
    rows = [(1, SHORT), (1, LONG), (2, LONG), (None, prose(803, 60)), (None, prose(804, 60)), (None, LONG + " " + prose(805, 50)), (1, None), (1, "")]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeated(documents(spark, rows)).collect())
    counts = Counter(tuple(w[s : s + 35]) for w in (spaced_words(t) for _, t in rows) for s in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = spaced_words(t)
        gone = {p for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    assert got == want


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, limit):
    rows = [*rows_of(prose(810, 40), prose(811, 20) + " " + ITEM, None), (1, ITEM), (1, ITEM)]
    items = [(7, ITEM), (8, ITEM), (9, prose(812, 30))]
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontamination.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit).collect())
    assert got == Counter((i, len(w := plain_words(t)), 14 if ITEM in (t or "") else 0, ("7", "8") if ITEM in (t or "") else ()) for i, t in rows)


def test_line_dedup_loses_no_line(spark):
    first, second, third = prose(820, 40), prose(821, 40), prose(822, 40)
    rows = [(5, first + "\n" + second), (5, first + "\n" + third), (None, second + "\n" + prose(823, 30)), (None, prose(824, 30) + "\n" + third), (6, prose(825, 30)), (6, None)]
    got = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = Counter(line for r in got for line in (r["text"] or "").split("\n") if re.search(r"\S", line))
    assert kept == Counter({line for _, t in rows if t for line in t.split("\n")})


def test_line_dedup_of_a_row_that_repeats(spark):
    rows = [(5, "one line here, long enough"), (5, "one line here, long enough"), (6, "one line here, long enough")]
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()) == [(5, rows[0][1]), (5, rows[0][1]), (6, "")]


def test_simhash_stage_keeps_one_row_of_each_group(spark, tmp_path):
    texts = [prose(830, 60), prose(831, 60), prose(832, 60)]
    rows = [*rows_of(*texts), (1, texts[0]), (2, texts[1]), (3, None), (None, None), (9, prose(833, 60))]
    got = corpus_pipeline.simhash_near_dedup(spark, documents(spark, rows), str(tmp_path)).collect()
    prints = defaultdict(list)
    for i, t in rows:
        prints[fingerprint(t)].append((i is None, i, t))
    assert len(prints) == 5  # none of these are near one another
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got), key=str) == sorted((min(g, key=str) for g in prints.values()), key=str)


def test_simhash_tells_rows_apart(spark):
    rows = rows_of(prose(840, 60), prose(841, 60))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in got} == {(i, fingerprint(t)) for i, t in rows}
    assert {r["component_id"] for r in got} == {1}


def test_common_boilerplate_loses_no_link(spark):
    """Pairs that are near copies (0.9 and more) over a long part that all lines share (0.7 across)."""
    common = prose(850, 75)
    lines = []
    for i in range(60):
        own = f"{common} {prose(900 + i, 18)}"
        lines += [own, own[:-1] + "#"]
    sets = [shingles(line) for line in lines]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[i], sets[i + 1]) >= 0.9 for i in range(0, 120, 2)) and like(sets[0], sets[2]) < 0.8
    got = line_dedup.dedup_lines(documents(spark, list(enumerate(lines)))).collect()
    assert {r["doc_id"] for r in got if r["_n_removed_"]} == set(range(1, 120, 2))
