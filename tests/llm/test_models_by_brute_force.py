"""Whole scores of the models against plain loops, and recall of the embedding filters."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from skillgraph.llm import embedding_dedup, langid, toxicity
from skillgraph.llm.common import char_grams
from tests.llm.helpers import prose


def buckets(text, orders, bits):
    """The bucket of every n-gram of a text, one n-gram at a time."""
    lowered = text.lower()
    return [int(char_grams([lowered[i : i + n]], n, bits)[0][0]) for n in orders for i in range(len(lowered) - n + 1)]


def test_language_id_scores(spark):
    words = {"en": "the of and thing house water with", "de": "der und nicht Haus Wasser über mit", "ja": "これ は 水 です 家 の"}
    rows = [(i, " ".join((w := words[k].split())[(i * 7 + j) % len(w)] for j in range(1 + i % 5)), k) for i, k in enumerate(["en", "de", "ja"] * 12)]
    rows += [(100, "a", None), (101, "ab", "de"), (102, "The Wasser", None), (103, None, None), (104, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, seen = defaultdict(Counter), Counter()
    for _, t, k in rows:
        if t is not None and k is not None:
            counts[k].update(buckets(t, (2, 3), 16))
            seen[k] += 1
    names = sorted(seen)
    for r in langid.predict(docs, langid.fit(docs), ("doc_id", "text"), "text").collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {k: math.log(seen[k] / sum(seen.values())) + sum(math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * 2**16)) for b in buckets(text, (2, 3), 16)) for k in names}
        best = max(names, key=lambda k: logs[k])
        assert r["lang_pred"] == best and math.isclose(r["score"], 1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel_tol=1e-9)


def test_toxicity_scores(spark):
    rows = [(i, prose(i, 30) + (" utter scumbags" if i % 4 == 0 else " kind regards"), int(i % 4 == 0)) for i in range(80)] + [(200, "abc", 0), (201, "", 1), (202, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    orders, bits = (5, 6), 20
    sets = {i: set(buckets(t or "", orders, bits)) for i, t, _ in rows}
    sizes = Counter(k for _, _, k in rows)
    counts = {k: Counter(b for i, _, label in rows if label == k for b in sets[i]) for k in (0, 1)}
    n = sizes[0] + sizes[1]
    ratio = {}
    for b in set(counts[0]) | set(counts[1]):
        p, q, both = (counts[1][b] + 0.5) / (sizes[1] + 1), (counts[0][b] + 0.5) / (sizes[0] + 1), (counts[1][b] + counts[0][b] + 1) / (n + 2)
        errors = abs(p - q) / math.sqrt(both * (1 - both) * (1 / sizes[1] + 1 / sizes[0]))
        ratio[b] = math.log((counts[1][b] + sizes[1] / n) / (sizes[1] + 1)) - math.log((counts[0][b] + sizes[0] / n) / (sizes[0] + 1))
        ratio[b] *= errors**4 / (errors**4 + 8.0**4)
    assert min(ratio.values()) < 0 < max(ratio.values())  # both kinds of evidence
    from pyspark.sql import functions as F

    order = [r["doc_id"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").collect()]
    labels = {i: k for i, _, k in rows}
    w, square = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-2)
    share = sizes[1] / n
    bias, bias_square = math.log(share / (1 - share)), 1.0
    draw = np.random.default_rng(0)
    for _ in range(8):
        for at in draw.permutation(len(order)).tolist():
            own = [b for b in sets[order[at]] if b in ratio]
            error = 1 / (1 + math.exp(-(sum(w[b] * ratio[b] for b in own) + bias))) - labels[order[at]]
            for b in own:
                square[b] += (error * ratio[b]) ** 2
                w[b] -= 0.2 * error * ratio[b] / math.sqrt(square[b])
            bias_square += error * error
            bias -= 0.2 * error / math.sqrt(bias_square)
    for r in toxicity.predict(docs, toxicity.fit(docs), ("doc_id",)).collect():
        want = 1 / (1 + math.exp(-(sum(w[b] * ratio[b] for b in sets[r["doc_id"]] if b in ratio) + bias)))
        assert math.isclose(r["score"], want, rel_tol=1e-6, abs_tol=1e-9)


def test_short_texts_alone():
    assert [len(char_grams(t, 6, 20)[0]) for t in (["abc"], ["", ""], [], ["ab", "cd"])] == [0, 0, 0, 0]
    assert char_grams(["ab", "cdefgh"], 6, 20)[1].tolist() == [0, 0, 1]


@pytest.mark.parametrize("size", [3_000, 12_000])
def test_recall_of_embedding_links(spark, size):
    """Planted pairs of cosine 0.98 to 0.985, the hardest links, among unlike vectors of one label."""
    draw = np.random.default_rng(size)
    base = draw.standard_normal((size, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pairs = size // 6
    aside = draw.standard_normal((pairs, 64))
    aside -= (aside * base[:pairs]).sum(axis=1, keepdims=True) * base[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = draw.uniform(0.9803, 0.985, (pairs, 1))
    base[size - pairs :] = cosine * base[:pairs] + np.sqrt(1 - cosine**2) * aside
    df = spark.createDataFrame([(i, v.astype("float32").tolist(), 1) for i, v in enumerate(base)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    found = sum(got[size - pairs + i]["component_id"] == i for i in range(pairs))
    print("recall", size, found / pairs)
    assert found / pairs >= 0.9
    assert sum(r["n_links"] for r in got.values()) == 2 * found


def test_toxicity_sample_bounds(spark):
    """The regression's sample keeps both bounds, repeated rows of one hash too; every text of five characters has features."""
    rows = [(i // 3, prose(i // 3, 20), int(i // 3 % 2)) for i in range(90)]
    docs = spark.createDataFrame(rows, "h long, text string, toxic int")
    for most, features in ((7, 1 << 25), (90, 2000), (90, 1 << 25)):
        found, labels = toxicity._sample(docs, (5, 6), 20, most, features)
        want, spent = [], 0
        for h, text, toxic in sorted(rows)[:most]:
            spent += 2 * len(text)
            if spent > features:
                break
            want.append((set(buckets(text, (5, 6), 20)), toxic))
        assert [(set(f.tolist()), t) for f, t in zip(found, labels, strict=True)] == want
    with pytest.raises(ValueError, match="sample_features"):
        toxicity._sample(docs, (5, 6), 20, 5, 3)
    model = toxicity.fit(docs.withColumnRenamed("h", "doc_id"))
    scores = {r["score"] for r in toxicity.predict(spark.createDataFrame([(1, rows[0][1]), (2, rows[3][1]), (3, "")], "doc_id long, text string"), model, ("doc_id",)).collect()}
    assert len(scores) == 3
