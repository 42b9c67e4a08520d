"""A training corpus from raw documents: five operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``docs``; the last returns packed pieces
with their token ids. ``run`` applies them to ``documents`` and writes what each
keeps to the shared folder, so that none is computed twice.

Defined cases: further columns of ``docs`` have any names and pass all stages but the last unchanged, except n_chars, which
follows the text; what else holds for nulls, empty and long texts, ties, repeated rows and empty tables, each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgraph.llm import decontamination, langid, line_dedup, packing, simhash
from skillgraph.llm.common import row_keys, stored

#: A document's language must be at least so probable.
LEAST_LANGUAGE = 0.5
#: Lists of keys up to so many rows are broadcast (16 bytes each, 32 MB); longer ones join by shuffle.
BROADCAST_ROWS = 2_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., so that no name of theirs meets one of ours, and what their id and text are called there."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text")}


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with columns c0, c1, ..., and the keys of each row, k1 and k2."""
    own, at = _numbered(docs)
    k1, k2 = row_keys(at["doc_id"], at["text"])
    return own.withColumns({"k1": k1, "k2": k2})


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows with one of the keys (k1, k2)."""
    gone = stored(gone.select("k1", "k2").distinct(), "gone")
    listed = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return _keyed(docs).join(listed, ["k1", "k2"], "left_anti").drop("k1", "k2").toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; the model learns from the rows that name theirs."""
    model = langid.fit(docs)
    own, at = _numbered(docs)
    found = langid.predict(own, model, tuple(own.columns), at["text"])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*own.columns).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and nearly repeated lines out of all documents but the first that has them."""
    found = line_dedup.cleaned(docs)
    if "n_chars" in docs.columns:
        n_chars, text = (f"c{docs.columns.index(c)}" for c in ("n_chars", "text"))
        found = found.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema["n_chars"].dataType))
    return found.drop("n_lines", "n_removed").toDF(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the least id (null last). Rows of one id are told apart by their texts."""
    kept = _without(docs, simhash.others(simhash.near_duplicates(docs)))
    keyed, own = _keyed(kept), [f"c{i}" for i in range(len(docs.columns))]
    again = stored(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"), "again")
    if again.isEmpty():
        return kept
    # Rows with the same id and text: of those, the one whose other columns have the least hash.
    every = F.struct(*own)
    one = keyed.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by(every, F.xxhash64(every)).alias("row")).select("row.*")
    return keyed.join(again, ["k1", "k2"], "left_anti").select(*own).unionByName(one).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of 4096 tokens."""
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: Fingerprints and tokenizers can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
