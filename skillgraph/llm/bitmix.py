"""Logistic mixing of hashed-context bit predictors, as array operations on runs of bits.

A predictor is a table of bit counts whose slot is a hash of a context and the
bit's place in its symbol's code. Each slot predicts the logit of its counts. A
gate, made from how much the contexts have been seen and how deep the bit
lies, selects the weights that combine the logits; an adaptive map from the mixed
logit to what the bits then were refines the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of one table block that travels as one row.
BLOCK = 1 << 13
_SCALE = 16.0  # logits are kept as eighths of a byte's range: -8 to 8
_CELLS = 33  # of the adaptive map, over the mixed logit
GATES = 27
DEPTHS = 16


@dataclass
class Bits:
    """A run of bits: places in their codes, values, depths, contexts (one row for each predictor) and prior logits."""

    node: np.ndarray
    bit: np.ndarray
    depth: np.ndarray
    contexts: list[np.ndarray]
    prior: np.ndarray


@dataclass(frozen=True)
class Mixer:
    tables: tuple[np.ndarray, ...]  # per predictor, of each slot for each of three parts: four times the logit, and how often it has been seen
    weights: np.ndarray  # gates x (1 + predictors)
    refined: np.ndarray  # depths x cells: logits


@dataclass(frozen=True)
class Trained:
    """A mixer whose tables are broadcast once, for learning and for scoring."""

    tables: Broadcast
    weights: np.ndarray
    refined: np.ndarray

    def mixer(self) -> Mixer:
        return Mixer(self.tables.value, self.weights, self.refined)


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Nodes that differ in their last four bits only have neighbouring slots, which share a line of the cache."""
    h = (node >> np.uint32(4)) * np.uint32(0x9E3779B1)
    h ^= context
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    h ^= node & np.uint32(15)
    return h


def count_rows(streams: Callable[[pa.RecordBatch], Iterator[tuple[int, Bits]]], predictors: int, bits: int):
    """For mapInArrow: what each table has counted in a task, in blocks. Streams tell to which of two parts bits belong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, one = np.zeros((2, predictors, 2 << bits), np.int32), np.int32(1)
        for batch in batches:
            for part, run_of in streams(batch):
                for k, context in enumerate(run_of.contexts):
                    at = slots(context, run_of.node, bits).astype(np.intp)
                    at <<= 1
                    at |= run_of.bit
                    np.add.at(tables[part, k], at, one)
        flat = tables.reshape(-1, 2 * BLOCK)
        for b in np.flatnonzero(flat.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([flat[b].tobytes()], pa.binary())], ["block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b not in held:
                held[b] = np.zeros(2 * BLOCK, np.int64)
            held[b] += np.frombuffer(counts.as_buffer(), np.int32)
    for b, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], ["block", "counts"])


def counted(df: DataFrame, streams, predictors: int, bits: int) -> np.ndarray:
    """Counts of both parts over all rows: (2, predictors, slots, 2). Their size is fixed by ``predictors`` and ``bits``.

    Four input splits make one task, which sends its tables once.
    """
    partial = df.coalesce(max(1, df.rdd.getNumPartitions() // 4)).mapInArrow(count_rows(streams, predictors, bits), "block int, counts binary")
    spread = max(1, min(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total = np.zeros((2, predictors, 1 << bits, 2), np.int32)
    flat = total.reshape(-1, 2 * BLOCK)
    for row in partial.repartition(spread, "block").mapInArrow(_summed, "block int, counts binary").toLocalIterator():
        flat[row["block"]] += np.frombuffer(row["counts"], np.int32)
    return total


def quantised(table: np.ndarray) -> np.ndarray:
    """A predictor's slots: four times the logit, in sixteenths, and how often seen (0 to 2)."""
    none, some = table[:, 0].astype(np.float32), table[:, 1].astype(np.float32)
    logit = np.clip(np.rint(np.log((some + 0.4) / (none + 0.4)) * _SCALE), -127, 127).astype(np.int16)
    return logit * np.int16(4) + (none + some > 2) + (none + some > 24)


def by_part(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each predictor's slots for bits of part 0, by what part 1 has counted, then for those of part 1, by part 0, then for all others, by both."""
    return tuple(np.concatenate([quantised(own) for own in (counts[1, k], counts[0, k], counts[:, k].sum(axis=0))]) for k in range(counts.shape[1]))


def inputs(model: Mixer, run_of: Bits, part: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predictors + 1) x bits logits, and each bit's gate. ``part`` is that of all bits or of each: 0 or 1 if the tables have counted it, else 2."""
    x = np.empty((len(run_of.contexts) + 1, len(run_of.node)), np.float32)
    x[0] = run_of.prior
    gate = np.zeros(len(run_of.node), np.intp)
    offset = np.uint32(part)
    for k, context in enumerate(run_of.contexts):
        size = len(model.tables[k]) // 3
        at = slots(context, run_of.node, size.bit_length() - 1)
        at += offset * np.uint32(size)
        found = model.tables[k].take(at)
        np.multiply(found >> 2, np.float32(1 / _SCALE), out=x[k + 1])
        gate *= 3
        gate += found & 3
    return x, gate


def mixed_logit(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    weights = weights.astype(np.float32, copy=False)
    z = weights[:, 0].take(gate) * x[0]
    for k in range(1, len(x)):
        z += weights[:, k].take(gate) * x[k]
    return np.clip(z, -12, 12, out=z)


def refined_logit(model: Mixer, z: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Half the mixed logit, half what the adaptive map makes of it (linear between its cells)."""
    at = (z + np.float32(12)) * np.float32((_CELLS - 1) / 24)
    low = np.minimum(at.astype(np.intp), _CELLS - 2)
    at -= low
    low += depth * np.int32(_CELLS)
    flat = model.refined.ravel()
    at *= np.diff(flat, append=flat[-1:]).take(low)
    at += flat.take(low)
    at += z
    at *= np.float32(0.5)
    return at


def cost(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Bits of information: -log2 of the probability that the logit gives the bit."""
    spent = np.exp(z * (np.float32(1) - bit.astype(np.float32) * np.float32(2)))
    spent += np.float32(1)
    return np.log(spent, out=spent) * np.float32(1 / np.log(2))


def start_weights(predictors: int) -> np.ndarray:
    return np.full((GATES, predictors + 1), 0.9 / (predictors + 1) + 0.1, np.float32)


def learn_rows(shared, streams, predictors: int, step: int = 1 << 15):
    """For mapInArrow: weights learned online over a task's bits, and what its adaptive map has counted.

    ``shared`` holds the tables by part; each part is predicted without its own counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = start_weights(predictors)
        model = Mixer(shared.value, start, np.empty(0))
        weights, square = start.astype(np.float64), np.full(start.shape, 1e-3)
        seen = np.zeros((DEPTHS, _CELLS, 2))
        used = np.zeros(GATES)
        for batch in batches:
            for part, run_of in streams(batch):
                x_all, gate_all = inputs(model, run_of, part)
                for a in range(0, len(run_of.node), step):
                    x, gate, bit = x_all[:, a : a + step], gate_all[a : a + step], run_of.bit[a : a + step]
                    z = mixed_logit(weights, x, gate)
                    error = bit - 1 / (1 + np.exp(-z))
                    n = np.bincount(gate, minlength=GATES)
                    for k in range(len(x)):
                        g = np.bincount(gate, error * x[k], GATES) / np.maximum(n, 64)
                        square[:, k] += g * g
                        weights[:, k] += 0.05 * g / np.sqrt(square[:, k])
                    used += n
                    cell = run_of.depth[a : a + step] * np.int64(_CELLS) + np.rint((z + np.float32(12)) * np.float32((_CELLS - 1) / 24)).astype(np.intp)
                    seen += np.bincount(cell * 2 + bit, minlength=2 * DEPTHS * _CELLS).reshape(seen.shape)
        values = np.concatenate([(weights * used[:, None]).ravel(), used, seen.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

    return run


def learned(df: DataFrame, shared: Broadcast, streams, predictors: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map: each task learns online, and weights are averaged by the bits that each gate saw."""
    rows = df.mapInArrow(learn_rows(shared, streams, predictors), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    weights, refined = start_weights(predictors).astype(np.float64), np.tile(np.linspace(-12, 12, _CELLS), (DEPTHS, 1))
    if rows:
        v = np.zeros(len(rows))
        for r in rows:
            v[r["i"]] = r["v"]
        size = weights.size
        used = v[size : size + GATES]
        some = used > 0
        weights[some] = v[:size].reshape(weights.shape)[some] / used[some, None]
        seen = v[size + GATES :].reshape(DEPTHS, _CELLS, 2)
        prior = 1 / (1 + np.exp(-refined))
        refined = np.log((seen[..., 1] + 8 * prior) / (seen[..., 0] + 8 * (1 - prior)))
    return weights.astype(np.float32), refined.astype(np.float32)


def trained(df: DataFrame, streams, predictors: int, bits: int) -> Trained:
    """Counts and weights from all of ``df``; each of two parts is always predicted by the other's counts."""
    tables = df.sparkSession.sparkContext.broadcast(by_part(counted(df, streams, predictors, bits)))
    return Trained(tables, *learned(df, tables, streams, predictors))
