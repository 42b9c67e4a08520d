import inspect
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skillgraph.llm import embedding_dedup, line_dedup, simhash
from skillgraph.llm.components import components as spark_components
from tests.llm.helpers import components, documents, lowered, prose, spaced_words, with_odd_rows


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 200), (None, 3)]
    found = {r["node"]: r["root"] for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200}


def fingerprint(text):
    words = spaced_words(lowered(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("tile", [2048, 2])
def test_simhash(spark, tile, monkeypatch):
    base = prose(1, 300)
    rows = with_odd_rows([(i, prose(i, 60)) for i in range(20)] + [(30 + i, base + " tail" * (i % 9)) for i in range(20)] + [(60, prose(3, 60).upper()), (61, prose(3, 60))])
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, radius: whole(d, radius, tile=tile))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    assert all(got[i]["fp"] & (2**64 - 1) == p for i, p in prints.items())
    want = components(list(prints), [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {i: got[i]["component_id"] for i in prints} == want
    assert len(got) == len(rows)


def test_simhash_blocks_miss_nothing():
    draw = np.random.default_rng(0)
    for radius, keep in ((4, 3), (4, 5)):
        masks = simhash.block_masks(radius, keep)
        a = draw.integers(0, 2**64, 3000, dtype=np.uint64)
        flips = np.zeros(3000, np.uint64)
        for _ in range(radius):
            flips |= np.uint64(1) << draw.integers(0, 64, 3000).astype(np.uint64)
        pa, pb = simhash.popcounts(a), simhash.popcounts(a ^ flips)
        assert np.any([(pa & np.uint64(m)) == (pb & np.uint64(m)) for m in masks], axis=0).all()
        near = np.bitwise_count(simhash._unary(pa) ^ simhash._unary(pb))
        assert (near <= np.bitwise_count(flips)).all()


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [1024, 3])
def test_embeddings(spark, tile):
    draw = np.random.default_rng(3)
    centers = draw.standard_normal((12, 64))
    rows = [(i, (centers[i % 12] + draw.standard_normal(64) * (0.1 if i % 3 else 1.0)).astype("float32").tolist(), i % 2) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, None, 0), (303, [0.0] * 64, 0), (304, [float("nan")] * 64, 0), (305, [None] * 64, 0), (306, rows[0][1], None), (307, rows[0][1][:32], 0), (308, [float("inf")] * 64, 0), (309, [3 * x for x in rows[0][1]], 0), (310, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    good = {i: (np.array(e, "float32").astype(float), l) for i, e, l in rows if e and l is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    unit = {i: (e / np.linalg.norm(e), l) for i, (e, l) in good.items()}
    links = [(a, b) for a, b in combinations(unit, 2) if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    assert links
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = components([i for i, _, _ in rows], links)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (degree[i], want[i], want[i] == i) for i, _, _ in rows}


def shingles(line, size=12):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


@pytest.mark.parametrize("small", [24, 3])
def test_line_dedup(spark, small):
    base = [prose(i, 40, 80) for i in range(8)]
    near = [base[0].replace("ba", "bo", 1), base[0] + " plus", base[1][:-6], base[2].replace(" ", "  ", 1)]
    rows = with_odd_rows([(1, "\n".join(base[:4])), (2, "\n".join([near[0], base[5], "", near[1]])), (3, "\n".join([near[2], near[3], base[0]])), (4, base[3] + "\n \n" + base[3] + "\nok\nok"), (5, base[6]), (6, base[6])])
    rows += [(50 + i, base[7] + f" end {i}") for i in range(12)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, rows), small=small).collect()}
    places = {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate(t.split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                places.setdefault(line, []).append((-1 if i is None else i, n))
    sets = {line: shingles(line) for line in places}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = components(list(places), links)
    kept = {}
    for line, at in places.items():
        kept[roots[line]] = min(kept.get(roots[line], at[0]), at[0])
    for i, t in rows:
        if t is None:
            assert got[i]["text"] is None
            continue
        stay = [line for n, line in enumerate(t.split("\n")) if not line.strip(" \t\n\r\x0b\x0c") or kept[roots[line]] == (-1 if i is None else i, n)]
        assert got[i]["text"] == "\n".join(stay), i
        assert got[i]["_n_removed_"] == len(t.split("\n")) - len(stay)
    assert got[1]["lang"] == "en" and len(got) == len(rows)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


@pytest.mark.parametrize("direct", [0, 20_000_000])
def test_large_bucket_loses_no_line(spark, direct):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(60):  # pairs behind one shared signature
        one = "Internationally" + word(18)
        lines += [one, one + "s"]
    base = [word(draw.randrange(4, 9)) for _ in range(80)]
    for _ in range(80):  # like the base, and mostly unlike each other
        changed = list(base)
        for at in draw.sample(range(80), 3):
            changed[at] = word(6)
        lines.append(" ".join(changed))
    lines.append(" ".join(base))
    sets = {line: shingles(line) for line in lines}
    roots = components(lines, [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert len(set(roots.values())) < 80
    first = {}
    for i, line in enumerate(lines):
        first.setdefault(roots[line], i)
    got = line_dedup.dedup_lines(documents(spark, list(enumerate(lines))), direct=direct).collect()
    assert {r["doc_id"] for r in got if r["_n_removed_"]} == set(range(len(lines))) - set(first.values())


def test_bands_meet_lines_near_the_bound(spark):
    with_default = {n: p.default for n, p in inspect.signature(line_dedup.links).parameters.items()}
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 9)))
    want = []
    while len(want) < 1500:
        one = [word() for _ in range(draw.randrange(20, 60))]
        two = list(one)
        for at in draw.sample(range(len(two)), 1 + len(two) // 25):
            two[at] = word()
        a, b = " ".join(one), " ".join(two)
        if 0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.85:
            want.append((a, b))
    df = spark.createDataFrame([(x,) for pair in want for x in pair], "line string")
    name = {r[0]: r[1] for r in df.select("line", F.xxhash64("line")).collect()}
    keys = {r["h"]: set(r["keys"]) for r in line_dedup.signatures(df, *(with_default[n] for n in ("shingle", "bands", "rows"))).collect()}
    assert sum(bool(keys[name[a]] & keys[name[b]]) for a, b in want) >= 1495


def test_lines_left_in_large_buckets_meet_in_tiles(spark):
    """Tiles of three on both sides find what one tile finds."""
    base = prose(4242, 40).split()
    texts = [" ".join(w if k != i % 40 else f"x{i}" for k, w in enumerate(base)) for i in range(40)] + [prose(7, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [sorted(map(tuple, line_dedup.dedup_lines(docs, small=2, leaders=1, direct=0, tile=t).collect())) for t in (3, 1024)]
    assert found[0] == found[1] and sum(r[-1] for r in found[0]) >= 30


def test_sketches_tell_no_two_lines_further_apart_than_they_are(spark):
    lines = [prose(1000 + i, 30) for i in range(12)]
    lines += [lines[0].replace("ba", "bo", 2), lines[1][:-3], "short", "é" * 40]
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    grams = [{t[i : i + 12] for i in range(max(1, len(t) - 11))} for t in lines]
    for longs in (8, 32):
        got = {r["h"]: r for r in line_dedup.sketches(texts, 12, longs).collect()}
        assert [got[i]["size"] for i in range(len(lines))] == [len(g) for g in grams]
        for i in range(len(lines)):
            for j in range(i):
                differ = sum(bin((got[i][f"k{k}"] ^ got[j][f"k{k}"]) & (2**64 - 1)).count("1") for k in range(longs))
                apart = len(grams[i] ^ grams[j])
                assert differ <= apart and differ % 2 == apart % 2
