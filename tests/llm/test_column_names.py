"""Further columns of any name pass through unchanged."""

import corpus_pipeline
from pyspark.sql import functions as F

from skillgraph.llm import line_dedup
from tests.llm.helpers import prose

NAMES = ("_GONE_", "_k1_", "_k2_", "_n_removed_", "_n_gone_", "_text_", "a.b", "k1", "gone", "c0", "c3", "n_lines", "root", "lang_pred", "score", "fp", "count", "part", "own", "_row_", "weird `name`")


def made(spark):
    rows = [(i, f"{prose(i, 30)}\n{prose(1000 + i % 3, 20)}\n{prose(i, 12)}", "en", 7) for i in range(12)] + [(99, None, "en", None), (3, "", None, 0), (5, prose(5, 200), "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for k, n in enumerate(NAMES)])


def unchanged(df, names=NAMES):
    inner = df.toDF(*[f"x{i}" for i in range(len(df.columns))])
    at = {n: f"x{df.columns.index(n)}" for n in ("doc_id", *names)}
    for row in inner.collect():
        for n in names:
            assert row[at[n]] == f"{NAMES.index(n)}:{row[at['doc_id']]}"
    return True


def test_dedup_lines(spark):
    docs = made(spark)
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [c for c in docs.columns if c != "_n_removed_"] + ["_n_lines_", "_n_removed_"]
    assert found.count() == docs.count() and unchanged(found, [n for n in NAMES if n != "_n_removed_"])
    assert found.agg(F.sum("_n_removed_")).first()[0] >= 9


def test_stages(spark, tmp_path):
    docs = made(spark)
    sf_dir = str(tmp_path)
    spark.createDataFrame([(1, prose(2, 25))], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and unchanged(kept) and kept.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
