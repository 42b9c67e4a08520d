import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import components, prose
from tests.llm.test_near_duplicates import fingerprint

ITEM = prose(700, 14)


def source(spark):
    texts = {i: prose(i, 60) for i in range(12)}
    texts[20] = texts[3]  # a copy
    texts[21] = texts[4] + "\n" + prose(21, 40)  # a line seen before
    texts[22] = prose(22, 30) + " " + ITEM + " " + prose(23, 30)
    texts |= {30: None, 31: "", 32: "12 !! 34", 33: prose(33, 5000)}
    rows = [(i, t, "xx" if i % 2 else "yy", "s", len(t or ""), "clash") for i, t in texts.items()] + [(5, texts[5], "xx", "s", len(texts[5]), "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string"), texts


def test_stages(spark, tmp_path):
    docs, texts = source(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{n}"))
        now = spark.read.parquet(str(tmp_path / f"stage{n}"))
        kept[name] = now.collect()
        if n < 4:
            assert now.columns == docs.columns
    known = {i for i in texts if i not in (30, 31, 32)}
    assert {r["doc_id"] for r in kept["language_id"]} == known
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert set(lines) == known and lines[20] == "" and lines[21] == texts[21].split("\n")[1] and lines[0] == texts[0]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    prints = {i: fingerprint(t) for i, t in lines.items()}
    group = components(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    one = [r["doc_id"] for r in kept["simhash_near_dedup"]]
    assert sorted(one) == sorted(set(group.values()))
    clean = {r["doc_id"]: r["text"] for r in kept["benchmark_decontamination"]}
    assert set(clean) == set(one) - {22}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in clean.items()}
    got = {}
    for r in sorted(kept["packing"], key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want


def test_run_is_the_stages(spark, tmp_path):
    docs, _ = source(spark)
    docs.where("doc_id < 4 or doc_id = 22").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}
