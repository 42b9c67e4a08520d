"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. Over all labelled training rows Spark counts, for each hashed n-gram, the
   toxic and the other texts that have it.
2. Every n-gram is a feature, scaled by its log-count ratio. Ratios shrink by how surely the
   counts tell the classes apart: one whose shares differ by ``surety`` standard errors keeps
   half of it, others more or less; none is left out. 2^bits bounds the tables.
3. A logistic regression on those features (present or absent) is learned online on
   a bounded sample, the labelled rows with the least hash of their id and text, up to
   ``sample_rows`` of them and ``sample_features`` features in all; both bounds keep what
   comes to the driver small.

Defined cases: a null text is an empty one and gets the model's bias; a null
label or id teaches nothing; without rows of both classes every score is the
training rate (0 without any row); repeated rows count each time; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import char_grams, decoded, text_slices


@dataclass(frozen=True)
class ToxicityModel:
    orders: tuple[int, ...]
    bits: int
    weights: np.ndarray
    bias: float


class _Presence:
    """The buckets of each text's n-grams, each once. ``seen`` keeps, by bucket, when it was met last, so nothing is sorted or cleared."""

    def __init__(self, orders: tuple[int, ...], bits: int) -> None:
        self.orders, self.bits = orders, bits
        self.seen, self.clock = np.full(1 << bits, -1, np.int64), 0

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        lowered = [t.lower() for t in texts]
        found = [char_grams(lowered, n, self.bits) for n in self.orders]
        for i in range(len(texts)):
            own = np.concatenate([grams[starts[i] : starts[i + 1]] for grams, starts in found])
            at = np.arange(self.clock, self.clock + len(own))
            self.clock += len(own)
            self.seen[own] = at
            yield own[self.seen[own] == at]


def _counter(orders: tuple[int, ...], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        present = _Presence(orders, bits)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, _, data, offsets in text_slices(batch.column("text")):
                for i, own in enumerate(present(decoded(data, offsets)), first):
                    counts[toxic[i], own] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[1, at]), pa.array(counts[0, at])], ["bucket", "toxic", "other"])

    return count


def _extractor(orders: tuple[int, ...], bits: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _Presence(orders, bits)
        for batch in batches:
            found = [np.sort(f).astype("<i4").tobytes() for _, _, data, offsets in text_slices(batch.column("text")) for f in present(decoded(data, offsets))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(found, pa.binary())], ["h", "toxic", "features"])

    return extract


def _ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, surety: float) -> np.ndarray:
    """Log-count ratios, one text's worth of both classes added by their shares, shrunk by the standard errors between the classes."""
    rows = n_toxic + n_other
    both = (toxic + other + 1) / (rows + 2)
    apart = (toxic + 0.5) / (n_toxic + 1) - (other + 0.5) / (n_other + 1)
    errors = (apart / np.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_other))) ** 4
    ratio = np.log((toxic + n_toxic / rows) / (n_toxic + 1)) - np.log((other + n_other / rows) / (n_other + 1))
    return ratio * errors / (errors + surety**4)


def _sample(labelled: DataFrame, orders: tuple[int, ...], bits: int, sample_rows: int, sample_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the rows with the least hashes, as many as both bounds allow."""
    most = F.least(F.length("text") * len(orders), F.lit(1 << bits)).cast("long")
    sizes = labelled.select("h", "toxic", most.alias("most")).orderBy("h", "toxic").limit(sample_rows).collect()
    rows = int(np.searchsorted(np.cumsum([r["most"] for r in sizes]), sample_features, "right"))
    if not rows:
        raise ValueError("sample_features is less than one text may have")
    # Rows of one id and text share a hash; those of the last hash are let through by their number and cut here.
    cut, spare = sizes[rows - 1]["h"], F.col("h") < sizes[rows - 1]["h"]
    last = labelled.where(F.col("h") == cut).orderBy("toxic").limit(rows)
    told = labelled.where(spare).unionByName(last).select("h", "text", "toxic").mapInArrow(_extractor(orders, bits), "h long, toxic int, features binary").toArrow()
    toxic, features = told["toxic"].to_numpy(), told["features"]
    order = np.lexsort((toxic, told["h"].to_numpy()))[:rows]
    return [np.frombuffer(features[i].as_buffer(), "<i4") for i in order.tolist()], toxic[order].astype(float)


def _logistic(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rate: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights of present features times their ratios, and the bias: stochastic gradients with a step for each weight (AdaGrad)."""
    w, square = np.zeros(len(ratio)), np.full(len(ratio), 1e-2)
    share = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    bias, bias_square = float(np.log(share / (1 - share))), 1.0
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)).tolist():
            own = rows[i]
            error = 1 / (1 + np.exp(-np.clip(w[own] @ ratio[own] + bias, -30, 30))) - labels[i]
            g = error * ratio[own]
            square[own] += g * g
            w[own] -= rate * g / np.sqrt(square[own])
            bias_square += error * error
            bias -= rate * error / np.sqrt(bias_square)
    return w, bias


def fit(labelled: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", orders: tuple[int, ...] = (5, 6), bits: int = 20, surety: float = 8.0, sample_rows: int = 10_000, sample_features: int = 1 << 24, rate: float = 0.2, epochs: int = 8) -> ToxicityModel:
    """Learns from every row with an id and a label of 0 or 1; the regression from ``sample_rows`` of them at most, with ``sample_features`` features at most."""
    labelled = labelled.select(F.xxhash64(id_column, text).alias("h"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    sizes = dict(labelled.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        share = np.clip(sizes.get(1, 0) / max(1, sum(sizes.values())), 1e-9, 1 - 1e-9)
        return ToxicityModel(orders, bits, np.zeros(1 << bits), float(np.log(share / (1 - share))))
    schema = T.StructType().add("bucket", T.IntegerType()).add("toxic", T.LongType()).add("other", T.LongType())
    counts = labelled.select("text", "toxic").mapInArrow(_counter(orders, bits), schema).groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    bucket, toxic, other = (counts[c].to_numpy() for c in ("bucket", "toxic", "other"))
    ratio = np.zeros(1 << bits)
    ratio[bucket] = _ratios(toxic, other, sizes[1], sizes[0], surety)
    features, labels = _sample(labelled, orders, bits, sample_rows, sample_features)
    w, bias = _logistic(features, labels, ratio, rate, epochs)
    return ToxicityModel(orders, bits, w * ratio, bias)


def predict(docs: DataFrame, model: ToxicityModel, columns: tuple[str, ...], text: str = "text") -> DataFrame:
    """``columns`` of each row, then score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*columns).schema.fields]).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        present = _Presence(model.orders, model.bits)
        for batch in batches:
            z = [model.weights[f].sum() + model.bias for _, _, data, offsets in text_slices(batch.column(batch.num_columns - 1)) for f in present(decoded(data, offsets))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.array(z, float))))], [f.name for f in schema.fields])

    return docs.select(*columns, F.col(text).alias("_text_")).mapInArrow(run, schema)
