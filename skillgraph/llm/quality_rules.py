"""Quality rules: isolation forests on the rules' statistics of each document.

The statistics are counts over the whole text. A forest looks at a few shares made of them (``FORESTS``): each of its trees
splits a small sample of good labelled documents, and the range of all labelled ones with it, by random features at random
values. Documents that such splits isolate early, by the mean length of their paths, are anomalous. How early is too early is
calibrated on all labelled documents: a forest's threshold is the one that catches the most bad ones when each good one that
it loses weighs ``weight`` times a bad one; a forest for which none is worth it rejects nothing. Growing trees on good
documents alone keeps many alike bad ones from hiding each other.

Defined cases: a null text has no words and fails the base rules; without labelled documents of both kinds, all that pass the
base rules are kept; rows whose label is null, or whose text fails the base rules, teach nothing; repeated rows are judged
each; a document with several labels counts as good only if all say so; only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import _INSIDE, find_words, stored, text_slices, window_hashes, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5


def _within(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks are set in each text."""
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text in windows of five words that are there twice or more."""
    hashes = window_hashes(words, WINDOW)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(text[: len(hashes)] == text[WINDOW - 1 :]) if len(hashes) else np.empty(0, np.int64)
    own, hashes = text[inside], hashes[inside]
    order = np.lexsort((hashes, own))
    same = (own[order][1:] == own[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begins = inside[order[twice]]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + WINDOW, -1)
    return _within(np.cumsum(covered[:-1]) > 0, first)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' counts of each text of a slice."""
    starts, ends, first = find_words(data, offsets)
    raw = data.tobytes()
    lines, repeats = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = [x for x in raw[a:b].split(b"\n") if x.strip(_SPACES)]
        lines.append(len(own))
        repeats.append(len(own) - len(set(own)))
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": _within(_INSIDE[data] & (data & 0xC0 != 0x80), offsets),
        "n_symbols": _within(_SYMBOL[data], offsets),
        "n_dup_lines": np.array(repeats, np.int64),
        "n_repeat_words": _repeated_words(word_hashes(data, starts, ends), first),
        "n_lines": np.array(lines, np.int64),
    }


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, a row for each: the feature a node splits by (-1 in leaves), its value, its left child (the right one follows), and the path length that a leaf stands for."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    sample: int


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n, which isolating one of n points costs."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(points: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """An isolation forest: each tree splits the box from ``low`` to ``high`` at random, until each of ``sample`` points is alone or the depth at which half of them are expected to be."""
    draw = np.random.default_rng(seed)
    sample = min(sample, len(points))
    depth = math.ceil(math.log2(max(2, sample)))
    nodes = 2 ** (depth + 1)
    feature, value, left, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes))
    for t in range(trees):
        waiting, used = [(0, points[draw.choice(len(points), sample, replace=False)], 0, low, high)], 1
        while waiting:
            node, own, deep, least, most = waiting.pop()
            wide = np.flatnonzero(most > least)
            if deep == depth or len(own) < 2 or not len(wide):
                length[t, node] = deep + _mean_path(len(own))
                continue
            f = draw.choice(wide)
            at = draw.uniform(least[f], most[f])
            less = own[:, f] <= at
            feature[t, node], value[t, node], left[t, node] = f, at, used
            here = np.arange(len(least)) == f
            waiting += [(used, own[less], deep + 1, least, np.where(here, at, most)), (used + 1, own[~less], deep + 1, np.where(here, at, least), most)]
            used += 2
    return Forest(feature, value, left, length, sample)


def anomaly(forest: Forest, points: np.ndarray) -> np.ndarray:
    """2^(-mean path length / expected one): near 1 for points that are isolated at once, 0.5 and less for common ones."""
    total, rows = np.zeros(len(points)), np.arange(len(points))
    for feature, value, left, length in zip(forest.feature, forest.value, forest.left, forest.length, strict=True):
        at = np.zeros(len(points), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, left[at] + (points[rows, f] > value[at]), at)
        total += length[at]
    return np.exp2(-total / len(forest.feature) / max(1.0, _mean_path(forest.sample)))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Shares of short texts are drawn towards the usual as if so many usual words stood there too.
USUAL_WORDS = 16
#: What the forests look at: words and symbols; repetition.
FORESTS = (("word_length", "symbols"), ("dup_lines", "repeat_words"))
#: Scores are compared in steps of 1 / STEPS.
STEPS = 1000


@dataclass(frozen=True)
class QualityModel:
    """``word_length``: mean of good documents. A forest's threshold: a score in steps that rejects, or None."""

    word_length: float
    forests: tuple[tuple[tuple[str, ...], Forest, int | None], ...]


def base_failed() -> Column:
    """Under ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_statistics(docs: DataFrame, columns: tuple[str, ...], text: str = "text") -> DataFrame:
    """``columns`` of each row, then its ``STATISTICS``. Columns of these names raise a ValueError."""
    if clash := sorted({c.lower() for c in columns} & set(STATISTICS)):
        raise ValueError(f"columns named like statistics: {clash}")
    kept = docs.select(*columns)
    place = columns.index(text) if text in columns else len(columns)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.LongType()) for c in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(data, offsets) for _, _, data, offsets in text_slices(batch.column(place))]
            own = [pa.array(np.concatenate([x[c] for x in found] or [np.empty(0, np.int64)]), pa.int64()) for c in STATISTICS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *own], schema.names)

    return (kept if text in columns else docs.select(*columns, F.col(text).alias("_text_"))).mapInArrow(run, schema)


def _features(word_length: float | Column) -> dict[str, Column]:
    words = F.col("n_words") + F.lit(USUAL_WORDS)
    return {
        "word_length": F.ln((F.col("word_chars") + F.lit(USUAL_WORDS) * word_length) / words),
        "symbols": F.col("n_symbols") / (F.col("n_symbols") + words),
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 1),
        "repeat_words": F.col("n_repeat_words") / words,
    }


def _scorer(model: QualityModel):
    """A column function: for each forest, the anomaly of its features in steps."""
    shared = [(names, forest) for names, forest, _ in model.forests]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def score(*columns: pd.Series) -> pd.Series:
        found, at = [], 0
        for names, forest in shared:
            found.append(np.floor(STEPS * anomaly(forest, np.stack([c.to_numpy() for c in columns[at : at + len(names)]], axis=1))).astype(np.int32))
            at += len(names)
        return pd.Series(list(np.stack(found, axis=1)))

    by_name = _features(F.lit(model.word_length))
    return score(*[by_name[c] for names, _ in shared for c in names])


def fit(labelled: DataFrame, label: str = "quality", sample_rows: int = 25_600, trees: int = 100, sample: int = 256, weight: float = 50.0, seed: int = 7) -> QualityModel:
    """Learns from rows with ``STATISTICS`` and a ``label`` of 1 (good) or 0 (bad).

    Trees are grown on the ``sample_rows`` good rows with the least hashes at most; ranges and thresholds come from all rows.
    """
    labelled = stored(labelled.where(F.col(label).isin(0, 1) & ~base_failed()).select((F.col(label) == 1).alias("good"), *STATISTICS), "labelled")
    sums = labelled.where("good").agg(F.sum("word_chars").alias("c"), F.sum("n_words").alias("w")).first()
    kinds = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    if len(kinds) < 2:
        return QualityModel(0.0, ())
    usual = sums["c"] / sums["w"]
    by_name = _features(F.lit(usual))
    featured = labelled.select("good", *STATISTICS, *[c.alias(n) for n, c in by_name.items()])
    ranges = featured.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in by_name for f in (F.min, F.max)]).first()
    first = featured.where("good").orderBy(F.xxhash64(*STATISTICS, F.lit(seed)), *STATISTICS).limit(sample_rows).select(*by_name).collect()
    points = np.array([tuple(r) for r in first])
    places = {n: i for i, n in enumerate(by_name)}
    grown = []
    for k, names in enumerate(FORESTS):
        low, high = (np.array([ranges[f"{side}_{n}"] for n in names]) for side in ("min", "max"))
        grown.append((names, grow(points[:, [places[n] for n in names]], low, high, trees, sample, seed + k), None))
    model = QualityModel(usual, tuple(grown))
    scored = labelled.select("good", F.posexplode(_scorer(model)).alias("forest", "step"))
    counts = np.zeros((len(FORESTS), 2, STEPS + 2))
    for r in scored.groupBy("forest", "good", "step").count().collect():  # two forests, two kinds, STEPS + 1 steps at most
        counts[r["forest"], int(r["good"]), r["step"]] = r["count"]
    calibrated = []
    for k, (names, forest, _) in enumerate(grown):
        over = counts[k, :, ::-1].cumsum(axis=1)[:, ::-1]  # rows of each kind at a step or beyond
        gain = over[0] / kinds[False] - weight * over[1] / kinds[True]
        best = len(gain) - 1 - int(gain[::-1].argmax())  # of equal ones the most lenient
        calibrated.append((names, forest, best if gain[best] > 0 else None))
    return QualityModel(usual, tuple(calibrated))


def judge(found: DataFrame, model: QualityModel) -> DataFrame:
    """Rows with ``STATISTICS``, with base_failed and kept besides."""
    passed = ~base_failed()
    if any(t is not None for _, _, t in model.forests):
        limits = F.array(*[F.lit(STEPS + 1 if t is None else t) for _, _, t in model.forests])
        passed = passed & F.forall(F.zip_with(_scorer(model), limits, lambda step, limit: step < limit), lambda below: below)
    return found.select("*", base_failed().alias("base_failed"), passed.alias("kept"))
