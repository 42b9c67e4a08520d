"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgraph.llm import centroids, decontamination, embedding_dedup, langid, licenses, line_dedup, lm_scoring, packing, quality_rules, simhash, source_audit, substring_dedup, toxicity
from skillgraph.llm.common import remainder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 5) == 0).alias("held_out"))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null")
    if labels.count() <= 2_000_000:  # 32 MB
        labels = F.broadcast(labels)
    model = toxicity.fit(docs.where("not held_out").join(labels, "doc_id"))
    scored = toxicity.predict(docs, model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines_").alias("n_lines"), F.col("_n_removed_").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(quality_rules.rule_statistics(_table(spark, sf_dir, "documents"), ("doc_id",)), "statistics")
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = quality_rules.fit(found.join(labels, "doc_id"))
    return quality_rules.judge(found, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, middles = centroids.ball_kmeans(_table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # 16 rows
    long = [x if x < 1 << 63 else None for x in (*(sums.get(i, 0) for i in range(len(middles))), sum(sums.values()))]
    about = spark.createDataFrame([(i, long[i], long[-1], centroids.digest(c)) for i, c in enumerate(middles)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_packing, op3_language_id, op4_substring_dedup, op5_toxicity, op6_line_dedup, op7_decontamination, op8_license_scan, op9_embedding_near_dedup, op10_simhash_near_dedup, op11_source_divergence, op12_quality_rules, op13_centroid_clustering)}
