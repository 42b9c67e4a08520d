import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from skillgraph.llm import bitmix, langid, lm_scoring, memory, toxicity
from skillgraph.llm.common import remainder
from tests.llm.helpers import documents, lowered, prose, spaced_words, with_odd_rows


def test_language_id(spark):
    words = {"en": "the of and thing house water with", "de": "der und nicht Haus Wasser über mit", "ja": "これ は 水 です 家 の"}
    rows = [(i, " ".join((w := words[k].split())[(i * 7 + j) % len(w)] for j in range(12)), k) for i, k in enumerate(["en", "de", "ja"] * 30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !?", None), (203, "the house and the water", None), (None, "der Haus und Wasser", None), (204, "the house " * 20000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    model = langid.fit(docs.where("doc_id < 60"))
    got = {r["doc_id"]: r for r in langid.predict(docs, model, ("doc_id",)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[60:90])
    assert {got[i]["lang_pred"] for i in (200, 201, 202)} == {"und"} and got[200]["score"] == 0
    assert (got[203]["lang_pred"], got[None]["lang_pred"], got[204]["lang_pred"]) == ("en", "de", "en")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    untaught = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, untaught, ("doc_id",)).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, max_languages=2)


def test_toxicity(spark):
    rows = [(i, prose(i, 60) + (" utter scumbags" if i % 4 == 0 else "") + " " + prose(i + 999, 40), int(i % 4 == 0)) for i in range(240)]
    odd = [(900, None, 0), (901, "", 0), (902, prose(5, 20000) + " scumbags", None), (None, "scumbags", 1), (1, rows[1][1], 0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int").withColumn("bucket", F.lit(3))
    model = toxicity.fit(docs.where("doc_id < 160 or doc_id >= 900"))
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, model, ("doc_id",)).collect()}
    held = [(got[i] >= 0.3) == bool(t) for i, _, t in rows[160:]]
    assert sum(held) >= 0.95 * len(held)
    assert 0 <= got[900] == got[901] < 0.3 and 0 <= got[902] <= 1
    one_class = toxicity.fit(docs.where("toxic = 0"))
    assert {round(r["score"], 3) for r in toxicity.predict(docs, one_class, ("doc_id",)).collect()} == {0.0}
    assert toxicity.predict(docs, toxicity.fit(docs.limit(0)), ("doc_id",)).count() == len(rows) + 5


@pytest.mark.parametrize("vocabulary", [1 << 17, 20])
def test_lm_scoring(spark, vocabulary):
    rows = with_odd_rows([(i, prose(i, 80, 50)) for i in range(60)]) + [(5, prose(5, 80, 50)), (950, "w" * 300 + " " + prose(3, 10)), *[(960 + i, "v" * 200 + " " + "v" * 201) for i in range(9)]]
    got = lm_scoring.score(documents(spark, rows), vocabulary=vocabulary).collect()
    tokens = {i: [*spaced_words(lowered(t)), None] for i, t in rows}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*spaced_words(lowered(t)), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert -1e9 < r["score"] < 0


def test_lm_scoring_without_training(spark):
    docs = documents(spark, [(i, "a b") for i in range(40)]).where(remainder("doc_id", 7) == 2)
    rows = lm_scoring.score(docs).collect()
    assert rows and {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(3, 0, 0, 0.0)}
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_every_bit_of_a_code_has_contexts():
    words = [b"w%04d" % i for i in range(5000)]
    built = lm_scoring.build_vocabulary(words, [1] * len(words), 0)
    symbol = np.arange(len(words) + 1)
    bits, starts = lm_scoring._bits(built, symbol, [symbol.astype(np.uint32)])
    codes = {bytes(bits.bit[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)}
    assert len(codes) == len(symbol) and len(bits.contexts[0]) == len(bits.node) and bits.depth.max() < bitmix.DEPTHS


def test_long_words_have_codes_of_their_own():
    words = [b"x" * 64, b"x" * 64, b"y"]
    built = lm_scoring.build_vocabulary(words, [5, 3, 1], 2, np.array([11, 7, 9], np.uint64))
    assert built.find(np.array([11, 7, 9, 8], np.uint64)).tolist() == [1, 2, 3, 0]
    codes = [built.code_bit[a:b].tolist() for a, b in zip(built.code_start[:-1], built.code_start[1:], strict=True)]
    assert len({tuple(c) for c in codes}) == 4


def test_contexts_elsewhere_by_plain_counting():
    """Counts and mixed costs of every token against plain loops over its text."""
    draw = np.random.default_rng(3)
    texts = [draw.integers(1, 6, draw.integers(0, 40)).tolist() for _ in range(60)] + [[], [7]]
    texts += [texts[0], texts[5]]
    teaches = [i % 3 > 0 for i in range(len(texts))]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    symbol = np.array([s for t in texts for s in t])
    h, counted = memory.contexts((symbol * 77).astype(np.uint64), first, symbol <= 2)
    places = [(i, k) for i, t in enumerate(texts) for k in range(len(t))]
    before = [(*texts[i][max(0, k - 3) : k],) for i, k in places]
    assert counted.tolist() == [any(s > 2 for s in b) for b in before]
    text = np.array([i for i, _ in places])
    at = np.flatnonzero(counted)
    spent = draw.permutation(len(at)) / 1024 + 0.5
    batch = memory.dealt(h[at], symbol[at], 8, spent, text[at], np.array(teaches)[text[at]], 5)
    assert batch.num_rows == 5
    got = {}
    for k in range(batch.num_rows):
        key, own, of, lesson = memory.taken(batch.slice(k, 1))
        seen, same, different = memory.counts(key, lesson, 4)
        mixed = memory.remembered(own, seen, same, different, lesson)
        for row in zip(of.tolist(), own.tolist(), seen.tolist(), same.tolist(), different.tolist(), mixed.tolist(), strict=True):
            got[row[:2]] = row[2:]
    assert len(got) == len(at)
    lessons = Counter((before[j], int(symbol[j])) for j in at if teaches[text[j]])
    for j, cost in zip(at.tolist(), spent.tolist(), strict=True):
        follows = Counter({s: n for (b, s), n in lessons.items() if b == before[j]})
        follows[int(symbol[j])] -= teaches[text[j]]
        seen, same, different, mixed = got[int(text[j]), cost]
        assert (seen, same, different) == (sum(follows.values()), follows[int(symbol[j])], sum(n > 0 for n in follows.values()))
        assert mixed == cost if not seen else mixed > 0


@pytest.mark.parametrize("block_tokens", [1 << 20, 500])
def test_texts_that_stand_elsewhere_too_cost_less(spark, block_tokens):
    rows = [(i, prose(i, 120, 50)) for i in range(150)] + [(1000 + i, prose(i, 120, 50)) for i in range(0, 150, 5)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_scoring.score(documents(spark, rows), frequent=8, block_tokens=block_tokens).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    twice = [got[i] for i in range(0, 150, 5) if not held(1000 + i)]
    once = [got[i] for i in range(150) if i % 5]
    assert len(got) == len(rows) and max(twice) < min(once)


def test_a_text_is_predicted_without_its_own_counts(spark):
    """Training texts and held-out ones of the same kind, none a copy, cost about the same; so does a slot by plain counting."""
    counts = np.random.default_rng(5).integers(0, 9, (2, 1, 16, 2)).astype(np.int32)
    model = bitmix.Mixer(bitmix.by_part(counts), bitmix.start_weights(1), np.empty(0))
    bits = bitmix.Bits(np.arange(40, dtype=np.uint32), np.zeros(40, np.uint8), np.zeros(40, np.int32), [np.arange(40, dtype=np.uint32) * np.uint32(7)], np.zeros(40, np.float32))
    part = np.arange(40) % 3
    x, _ = bitmix.inputs(model, bits, part.astype(np.uint32))
    at = bitmix.slots(bits.contexts[0], bits.node, 4)
    for i in range(40):
        none, some = (counts[1], counts[0], counts.sum(axis=0))[part[i]][0, at[i]]
        assert abs(x[1, i] - np.log((some + 0.4) / (none + 0.4))) < 0.04
        assert x[1, i] == bitmix.inputs(model, bits, int(part[i]))[0][1, i]
    # Words of one small set, so that no held-out text pays for unknown ones.
    draw = np.random.default_rng(6)
    words = np.array(prose(1, 60, 300).split())
    rows = [(i, " ".join(draw.choice(words, 120))) for i in range(300)]
    got = lm_scoring.score(documents(spark, rows)).collect()
    assert all(r["n_known"] == r["n_tokens"] for r in got)
    mean = {held: np.mean([r["score"] / r["n_tokens"] for r in got if r["held_out"] == held]) for held in (True, False)}
    print(mean)
    assert abs(mean[True] - mean[False]) < 0.05


def test_blocks_send_groups_no_row_for_each_text():
    """What a block changes of many texts comes in one row for each group, and each text gets the sum of all blocks."""
    passed = ["row", "doc_id"]
    draw = np.random.default_rng(8)
    n, tokens, blocks, groups = 3000, 30_000, 6, 4
    row = np.arange(n) + (5 << 33)
    text = np.sort(draw.integers(0, n - 500, tokens))
    h, symbol = draw.integers(0, 200, tokens).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), draw.integers(1, 4, tokens)
    told = memory.dealt(h, symbol, 8, draw.uniform(1, 9, tokens), row[text], text % 3 > 0, blocks)
    schema = pa.schema([*told.schema, ("row", pa.int64()), ("doc_id", pa.string())])
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(n) % blocks), pa.array(row), pa.array([f"d{i}" for i in range(n)])], ["block", *passed])
    table = pa.Table.from_batches([b for x in (told, rows) for b in memory.as_rows(x, schema)])
    mixed = pa.concat_tables([memory.mix_blocks(8, groups, passed)(table.filter(pc.equal(table["block"], b))) for b in range(blocks)])
    assert len(mixed) <= n + blocks * groups
    found = pa.concat_tables([memory.sum_groups(passed)(mixed.filter(pc.equal(mixed["group"], g))) for g in range(groups)])
    want = np.zeros(n)
    for k in range(told.num_rows):
        key, own, of, lesson = memory.taken(told.slice(k, 1))
        seen, same, different = memory.counts(key, lesson, 4)
        np.add.at(want, of - row[0], memory.remembered(own, seen, same, different, lesson) - own)
    got = dict(zip(found["doc_id"].to_pylist(), found["change"].to_pylist(), strict=True))
    assert len(found) == len(got) == n and np.abs(want).min() == 0 < np.abs(want).max()
    assert all(math.isclose(got[f"d{i}"], want[i], rel_tol=1e-5, abs_tol=1e-5) for i in range(n))
