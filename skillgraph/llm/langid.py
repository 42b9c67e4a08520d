"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are made per task as dense arrays, summed by Spark and
turned into one matrix of log probabilities (languages x buckets), whose
size is fixed by ``max_languages`` and ``bits`` and which is broadcast.
Scoring gathers the rows of that matrix for the n-grams of a batch of
texts and sums them by text.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows whose language is null teach nothing; without any training row all is
``und``; equal scores go to the language that sorts first; repeated rows are
scored (and counted) each; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import char_grams, decoded, segment_sums, text_slices

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    orders: tuple[int, ...]
    bits: int
    prior: np.ndarray
    log_probability: np.ndarray


def _counter(orders: tuple[int, ...], bits: int):
    def rows(languages: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(buckets, pa.int32()), pa.array(counts, pa.int64())], ["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush():
            for language, counts in held.items():
                at = np.flatnonzero(counts)
                yield rows(np.full(len(at), language, object), at, counts[at])
            held.clear()

        for batch in batches:
            languages = np.array(batch.column("lang").to_pylist(), object)
            for language in dict.fromkeys(languages.tolist()):
                texts = batch.column("text").filter(pa.array(languages == language))
                counts = held.setdefault(language, np.zeros(1 << bits, np.int64))
                for _, _, data, offsets in text_slices(texts):
                    lowered = [t.lower() for t in decoded(data, offsets)]
                    for n in orders:
                        counts += np.bincount(char_grams(lowered, n, bits)[0], minlength=1 << bits)
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    return count


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (2, 3), bits: int = 16, smoothing: float = 0.5, max_languages: int = 512) -> LanguageModel:
    """Learns from every row whose text and language are not null.

    Raises ValueError for more than ``max_languages`` languages: the model's size is bounded by that and ``bits``.
    """
    docs = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = docs.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    documents = {r["lang"]: r["count"] for r in found}
    languages = tuple(sorted(documents))
    counts = np.zeros((len(languages), 1 << bits))
    at = {language: i for i, language in enumerate(languages)}
    schema = T.StructType().add("lang", T.StringType()).add("bucket", T.IntegerType()).add("n", T.LongType())
    if languages:
        summed = docs.mapInArrow(_counter(orders, bits), schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        for (language,), part in summed.toPandas().groupby(["lang"]):
            counts[at[language], part["bucket"].to_numpy()] = part["n"].to_numpy()
    log_probability = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * (1 << bits))
    prior = np.log(np.array([documents[x] for x in languages], float) / max(1, sum(documents.values())))
    return LanguageModel(languages, orders, bits, prior, np.ascontiguousarray(log_probability.T))


def _score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    lowered = [t.lower() for t in texts]
    total = np.tile(model.prior, (len(texts), 1))
    for n in model.orders:
        grams, starts = char_grams(lowered, n, model.bits)
        step = max(1, (1 << 20) // len(model.languages))  # so many rows of the matrix are held at once
        for a in range(0, len(grams), step):
            total += segment_sums(model.log_probability[grams[a : a + step]], np.clip(starts - a, 0, len(grams[a : a + step])))
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = np.array([bool(_LETTER.search(t)) for t in texts])
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, columns: tuple[str, ...], text: str = "text") -> DataFrame:
    """``columns`` of each row, then lang_pred and score (the posterior probability of lang_pred). The text travels once, even if it is one of them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*columns)
    place = columns.index(text) if text in columns else len(columns)
    schema = T.StructType([*kept.schema.fields]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            labels: list[str] = []
            scores = [np.empty(0)]
            for _, _, data, offsets in text_slices(batch.column(place)):
                one, score = _score(shared.value, decoded(data, offsets))
                labels += one
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(labels, pa.string()), pa.array(np.concatenate(scores))], names)

    return (kept if text in columns else docs.select(*columns, F.col(text).alias("_text_"))).mapInArrow(run, schema)
