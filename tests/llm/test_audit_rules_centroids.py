"""Source audit, quality rules and ball k-means against plain loops."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgraph.llm import centroids, quality_rules, source_audit
from tests.llm.helpers import documents, lowered, prose, spaced_words, with_odd_rows


def audited(rows, least=3, top=200):
    """The rows of the audit for (text, lang, source), by plain loops."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(w, r[2]) for w, r in zip(words, rows, strict=True) if r[1] == lang]
        docs = Counter(t for w, _ in own for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        by_source = defaultdict(Counter)
        for w, source in own:
            by_source[source].update(w)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        share = {s: shares(c) for s, c in by_source.items()}
        whole = shares(sum(by_source.values(), Counter()))
        for s, p in share.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in share.items() if o != s]
            terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if by_source[s][t] and p[t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def test_source_audit(spark):
    rows = [(prose(i, 20 + i % 50, 40 + i % 7), ("en", "de", None)[i % 3], f"s{i % 5}" if i % 11 else None) for i in range(150)]
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("12 34 !!", "fr", "x"), ("Ünï ünï 日本 日本", "fr", "y"), (rows[0][0], *rows[0][1:]), (rows[0][0], *rows[0][1:]), ("ÀB àb Àb ab", "en", "s2"), (prose(3, 30000), "en", "s0")]
    docs = spark.createDataFrame([(i, *r, "z", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, `n` int")
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == audited(rows)


def test_source_audit_of_many_sources(spark):
    rows = [(" ".join(f"{chr(97 + (i * j) % 9)}x" for j in range(1 + i % 6)), "en", f"s{i % 140}") for i in range(420)]  # three blocks of sources
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    found = sorted(map(tuple, source_audit.audit(docs, top_terms=2).collect()))
    assert found == audited(rows, top=2)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_terms_in_pieces():
    data = ("é" * 3 + " Aa bB9c ").encode() * 50
    whole = source_audit.PIECE_BYTES
    try:
        source_audit.PIECE_BYTES = 7
        assert [w for piece in source_audit._pieces(data) for w in piece] == data.translate(source_audit._TERM_BYTES).split()
    finally:
        source_audit.PIECE_BYTES = whole


def ruled(text):
    words = spaced_words(text)
    text = text or ""
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if spaced_words(x)]
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n)


def test_rule_statistics(spark):
    rows = with_odd_rows([(i, prose(i, 5 + 9 * (i % 12), 40)) for i in range(60)])
    rows += [(300, "a b c d e a b c d e a b"), (301, "x\nx\n \nx y\n \n \n"), (302, "#*$ %&| <> é" * 9), (303, "one two three four five " * 400), (300, "a b c d e a b c d e a b"), (304, "\x0bé\x0c w")]
    found = quality_rules.judge(quality_rules.rule_statistics(documents(spark, rows), ("doc_id", "text", "part")), quality_rules.QualityModel(0.0, ()))
    assert found.columns[:3] == ["doc_id", "text", "part"] and found.count() == len(rows)
    for r in found.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == ruled(r["text"])
        assert r["kept"] == (not r["base_failed"])
    with pytest.raises(ValueError):
        quality_rules.rule_statistics(documents(spark, rows).withColumn("N_Words", F.lit(1)), ("doc_id", "N_Words"))
    assert quality_rules.rule_statistics(documents(spark, rows).limit(0), ("doc_id",)).count() == 0


def plain_anomaly(forest, point):
    """The path of one point, node by node."""
    total = 0.0
    for t in range(len(forest.feature)):
        node = 0
        while forest.feature[t, node] >= 0:
            node = int(forest.left[t, node]) + int(point[forest.feature[t, node]] > forest.value[t, node])
        total += forest.length[t, node]
    expected = 2 * (math.log(forest.sample - 1) + 0.5772156649015329) - 2 * (forest.sample - 1) / forest.sample
    return 2 ** (-total / len(forest.feature) / expected)


def test_quality_forest(spark):
    good = [(i, prose(i, 60 + i, 300), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" if k % 2 else w for k, w in enumerate(prose(i + 999, 80, 300).split())), 0) for i in range(60)]
    learned = [*good[:250], *bad[:40], (2000, None, 1), (2001, "short", 0), (2002, prose(5, 90), None)]
    docs = spark.createDataFrame([*learned, *good[250:], *bad[40:]], "doc_id long, text string, quality int")
    found = quality_rules.rule_statistics(docs, ("doc_id", "quality"))
    model = quality_rules.fit(found.where(~((F.col("doc_id") >= 250) & (F.col("doc_id") < 1000) | (F.col("doc_id") >= 1040) & (F.col("doc_id") < 2000))))
    (_, forest, threshold), (_, other, none) = model.forests
    assert threshold is not None and none is None  # repetition tells nothing here
    kept = {r["doc_id"]: r for r in quality_rules.judge(found, model).collect()}
    assert all(kept[i]["kept"] == (not kept[i]["base_failed"]) for i in range(250, 300))  # held out: good ones stay, bad ones go
    assert not any(kept[1000 + i]["kept"] for i in range(40, 60)) and not kept[2000]["kept"] and not kept[2001]["kept"] and kept[2002]["kept"]
    for i in (*range(0, 300, 7), *range(1000, 1060, 3)):
        r = kept[i]
        words = r["n_words"] + 16
        point = (math.log((r["word_chars"] + 16 * model.word_length) / words), r["n_symbols"] / (r["n_symbols"] + words))
        score = plain_anomaly(forest, point)
        assert abs(score * 1000 - threshold) < 1e-6 or r["kept"] == (not r["base_failed"] and score * 1000 < threshold)
    # Trees end where a point is alone, and no path is longer than the depth and what it stands for.
    assert (forest.length[forest.feature < 0] <= 8 + quality_rules._mean_path(forest.sample)).all()
    only_good = quality_rules.fit(found.where("quality = 1"))
    assert only_good.forests == () and quality_rules.judge(found, only_good).where("kept = base_failed").isEmpty()
    assert quality_rules.fit(found.limit(0)).forests == ()


def plainly_clustered(rows, k, rounds, components):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(64 * float(x)) for x in v)))
    middles = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(middles)):
            if there := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                middles[j] = tuple(sum(x) // len(there) for x in zip(*there, strict=True))
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), [list(m) for m in middles]


@pytest.mark.parametrize(("components", "k", "rounds"), [(4, 5, 3), (2, 16, 6), (3, 16, 0)])
def test_ball_kmeans(spark, components, k, rounds):
    draw = np.random.default_rng(components)
    rows = [(i, [float(x) for x in draw.normal(size=components) + 3 * (i % 4)]) for i in range(400)]
    rows += [(i, [0.25 * (i % 3)] * components) for i in range(400, 460)]  # ties and repeated vectors
    rows += [(500, None), (501, []), (502, [1.0] * (components + 1)), (503, [None] + [1.0] * (components - 1)), (504, [math.nan] * components), (505, [math.inf] * components), (506, [1e30] * components), (7, rows[7][1]), (7, rows[8][1])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    found, middles = centroids.ball_kmeans(vectors.repartition(5), k=k, rounds=rounds, components=components)
    expected, plain = plainly_clustered([r for r in rows if r[0] != 506], k, rounds, components)
    assert sorted(map(tuple, found.collect())) == expected and middles == plain


def test_balls_compare_only_relevant_neighbours():
    now = [[0, 0], [10, 0], [100, 0]]
    first = centroids.balls(now)
    assert first.neighbours == ((1, 2), (0, 2), (1, 0)) and first.annuli[0] == (25, 2500)
    later = centroids.balls(now, now, [16, 36, 4])
    assert later.neighbours == ((1,), (0,), ()) and later.settled == (True, True, True)  # 2 (isqrt(16) + 1) >= 10
    moved = centroids.balls(now, [[0, 0], [10, 0], [100, 7]], [16, 36, 4])
    assert moved.settled == (True, True, False)
    vectors = np.array([[1, 0], [5, 0], [6, 0], [99, 0]])
    got = centroids.reassigned(vectors, np.zeros(4, np.int64), np.zeros(4, np.int64), first)
    assert got[0].tolist() == [0, 0, 1, 2] and got[1].tolist() == [1, 25, 16, 1]


def test_few_vectors(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found, middles = centroids.ball_kmeans(vectors, components=2)
    assert sorted(r["cluster"] for r in found.collect()) == [0, 0] and middles == [[64, 128]] * 2
    found, middles = centroids.ball_kmeans(vectors.limit(0), components=2)
    assert found.count() == 0 and middles == []
