import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skillgraph.llm import decontamination, licenses, packing, substring_dedup
from tests.llm.helpers import documents, plain_words, prose, spaced_words, with_odd_rows


def test_substring_dedup(spark):
    shared, echo = prose(500, 60), prose(501, 20)
    rows = with_odd_rows([(i, prose(i, 90)) for i in range(12)] + [(20, prose(21, 30) + " " + shared + "\n" + prose(22, 30)), (21, shared), (22, prose(23, 5) + "\t" + shared + " " + shared), (23, (echo + " ") * 6), (24, prose(2, 90)), (25, "a " * 80), (26, " ".join(spaced_words(shared)[5:40]))])
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeated(documents(spark, rows)).collect()}
    words = {i: spaced_words(t) for i, t in rows}
    counts = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 34):
            if counts[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = True
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), gone.sum(), " ".join(x for x, g in zip(w, gone, strict=True) if not g)), i
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == gone.sum()
    assert len(got) == len(rows)
    again = substring_dedup.remove_repeated(documents(spark, [(1, shared), (1, shared)])).collect()
    assert [r["n_removed"] for r in again] == [60, 60]
    assert substring_dedup.remove_repeated(documents(spark, [])).count() == 0


def test_substring_dedup_shuffles_texts_once(spark):
    """The texts meet their anchors' places for windows and for the result in one shuffle."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        found = substring_dedup.remove_repeated(documents(spark, [(i, prose(i % 7, 60)) for i in range(20)]))
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum("ReusedExchange" in line and " text#" in line for line in plan) == 1


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, limit):
    items = [(1, prose(700, 30)), (2, prose(701, 12)), (3, "Ba né"), (4, None), (5, "!!"), (6, prose(700, 30)), (None, prose(704, 20)), (10, prose(702, 10))]
    rows = with_odd_rows([(i, prose(i, 80, 30)) for i in range(8)] + [(20, prose(20, 20) + " " + prose(700, 30).title() + "! " + prose(702, 10)), (21, " ".join(prose(701, 12).split()[:10])), (22, " ".join(prose(701, 12).split()[:9])), (23, prose(700, 30) + "-" + prose(700, 30)), (24, "ba, NÉ"), (25, "BA né"), (25, "BA né"), (26, prose(704, 20))])
    got = {r["doc_id"]: r for r in decontamination.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit).collect()}
    windows = {}
    for i, t in items:
        w = plain_words(t)
        if w and i is not None:
            n = min(10, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    for i, t in rows:
        w, found = plain_words(t), set()
        hit = np.zeros(len(w), bool)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit[s : s + n] = True
                    found |= windows[k]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), hit.sum(), sorted(found)), i
    assert got[20]["n_hit"] == 40 and not got[26]["n_hit"]
    none = spark.createDataFrame([], "item_id long, text string")
    clean = decontamination.contamination(documents(spark, rows), none)
    assert clean.count() == len(rows) and not clean.where("n_hit > 0").count()
    assert decontamination.contamination(documents(spark, []), none).count() == 0


def test_licenses(spark):
    notice = licenses.TEMPLATES["apache-2.0-notice"]
    grant = licenses.TEMPLATES["mit-grant"].split()
    changed = " ".join([*grant[:30], "CHANGED", *grant[31:]])
    rows = with_odd_rows([(i, prose(i, 200)) for i in range(6)] + [(20, prose(20, 333) + "\n// " + notice.upper() + "\n" + prose(21, 50)), (21, "Released under the MIT License."), (22, changed), (23, " ".join(grant[:20])), (24, prose(24, 1000) + " This work is licensed under the\nGNU General Public License, version 3. " + prose(25, 1000))])
    got = {(r["doc_id"], r["license"]): (r["containment"], r["start_word"]) for r in licenses.scan(documents(spark, rows)).collect()}
    grams = lambda t: [tuple(w[i : i + 5]) for w in [plain_words(t)] for i in range(len(w) - 4)]
    want = {}
    for i, t in rows:
        own = set(grams(t))
        for name, template in licenses.TEMPLATES.items():
            whole = set(grams(template))
            if len(own & whole) >= 0.8 * len(whole):
                want[i, name] = len(own & whole) / len(whole)
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert (22, "mit-grant") in got and (23, "mit-grant") not in got and got[20, "apache-2.0-notice"][1] == len(plain_words(prose(20, 333)))
    assert licenses.scan(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        licenses.scan(documents(spark, rows), {"short": "too short"})
    assert 1 - (1 - 0.2) ** licenses.bands_needed(0.2, 0.999) >= 0.999


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = with_odd_rows([(i, prose(i, 50 * i)) for i in range(25)] + [(60, "don't. It's; 'tis a<|endoftext|>b <|ENDOFTEXT|> İ ß."), (61, "x. y, (z) [w]. a.b c..d"), (3, prose(3, 150))])
    pieces = packing.tokenize(documents(spark, rows), path)
    got = packing.pack(pieces, group_pieces=20).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    used = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and any(ids == x[r["start"] : r["start"] + len(ids)] and r["doc_tokens"] == len(x) for x in texts[r["doc_id"]])
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(x) for xs in texts.values() for x in xs)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.tokenize(documents(spark, []), path)).count() == 0


def test_best_fit_decreasing_is_best_fit():
    draw = np.random.default_rng(1)
    lengths = np.sort(draw.integers(1, 101, 500))[::-1]
    sequence, offset = packing.best_fit_decreasing(lengths, 100)
    left, want = [], []
    for n in lengths.tolist():
        fits = [c for c in left if c >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
            want.append(100 - min(fits))
        else:
            left.append(100 - n)
            want.append(0)
    assert offset.tolist() == want and len(set(sequence.tolist())) == len(left)


def test_digests_agree():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0]))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
