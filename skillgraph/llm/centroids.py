"""Centroid clustering by ball k-means, in whole numbers.

Vectors become integers, so distances and means are exact and no order of sums matters. A cluster is a ball: its centroid
and a radius that no member's distance exceeds. Another centroid is its neighbour if half of the distance between the two
does not exceed that radius. Members within half of the distance to the nearest neighbour are the stable core: they stay,
without a comparison. The others lie in annuli, one more for each neighbour in order of distance, and a member of an annulus
is compared with the neighbours up to its own, exactly. A ball that has not moved, among neighbours that have not, keeps
its members as they are.

Vectors are never shuffled: each round is one pass that writes vectors with their clusters to the shared folder, and one that
sums them by task, cluster and component. k times the number of components of sums come to the driver.

Defined cases: vectors that are null, have another number of components, or one that is null or not finite are left out and
not returned; so are those with a component beyond ``LARGEST`` once scaled, whose distances a long may not hold; fewer vectors
than ``k`` give as many clusters; none give no rows; equal distances go to the smaller cluster number; repeated rows count
each; a null id hashes like an empty one; rows of one id start in order of their components; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import stored

#: With scaled components up to this, squared distances of 64 components fit a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Balls:
    """Centroids and, for each, the other centroids its members must be compared with: numbers, nearest first."""

    centroids: np.ndarray
    neighbours: tuple[tuple[int, ...], ...]
    #: Least squared distance of a member from its centroid at which it must be compared with each of them.
    annuli: tuple[tuple[int, ...], ...]
    #: Balls whose members stay as they are.
    settled: tuple[bool, ...]


def balls(now: list[list[int]], before: list[list[int]] | None = None, farthest: list[int] | None = None) -> Balls:
    """The balls of the centroids ``now``. ``farthest``: squared distance of each cluster's farthest member from ``before``.

    A centroid's move makes its radius greater by the move at most. Without ``before`` every other centroid is a neighbour.
    """

    def squared(x: list[int], y: list[int]) -> int:
        return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    moved = [before is None or x != y for x, y in zip(now, before or now, strict=True)]
    neighbours, annuli, settled = [], [], []
    for i, own in enumerate(now):
        others = sorted((squared(own, c), j) for j, c in enumerate(now) if j != i)
        if before is not None:
            radius = math.isqrt(farthest[i]) + 1 + (math.isqrt(squared(own, before[i])) + 1 if moved[i] else 0)
            others = [(d, j) for d, j in others if d <= 4 * radius * radius]
        neighbours.append(tuple(j for _, j in others))
        annuli.append(tuple((d + 3) // 4 for d, _ in others))  # 4 x squared distance >= d
        settled.append(not moved[i] and not any(moved[j] for _, j in others))
    return Balls(np.array(now, np.int64), tuple(neighbours), tuple(annuli), tuple(settled))


def reassigned(vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray, found: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and squared distance, given its cluster of before."""
    clusters, distances = clusters.copy(), distances.copy()
    for i in np.unique(clusters).tolist():
        if found.settled[i]:
            continue
        at = np.flatnonzero(clusters == i)
        own = np.square(vectors[at] - found.centroids[i]).sum(axis=1)
        best, least, apart = np.full(len(at), i), own.copy(), np.arange(len(at))
        for j, annulus in zip(found.neighbours[i], found.annuli[i], strict=True):
            apart = apart[own[apart] >= annulus]  # annuli widen: who is inside one is inside the next
            if not len(apart):
                break
            there = np.square(vectors[at[apart]] - found.centroids[j]).sum(axis=1)
            nearer = (there < least[apart]) | (there == least[apart]) & (j < best[apart])
            best[apart[nearer]], least[apart[nearer]] = j, there[nearer]
        clusters[at], distances[at] = -1 - best, least  # below zero: not met again as a member of another ball
    return np.where(clusters < 0, -1 - clusters, clusters), distances


def _scaled(column: pa.Array, components: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are kept, and floor(scale x component) of these."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == components)
    flat = column.take(pa.array(at)).flatten()
    values = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, components)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(scale * values)
        good = (np.abs(values) <= LARGEST).all(axis=1)  # false where it isn't a number
    return at[good], values[good].astype(np.int64)


def _lists(vectors: np.ndarray, components: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * components), pa.array(vectors.ravel().astype(np.int32)))


def _summed(components: int):
    """Sums by cluster and component, size and greatest distance, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            clusters, distances = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2).flatten().to_numpy().reshape(-1, components)
            for i in np.unique(clusters).tolist():
                at = clusters == i
                have = held.setdefault(i, [np.zeros(components, object), 0, 0])
                have[0] += vectors[at].sum(axis=0, dtype=np.int64).astype(object)
                have[1] += int(at.sum())
                have[2] = max(have[2], int(distances[at].max()))
        rows = [(i, c, s, n, far) for i, (sums, n, far) in held.items() for c, s in enumerate(sums)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["cluster", "component", "s", "n", "far"])

    return run


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector that is kept, and the centroids.

    The first centroids are the ``k`` kept vectors with the smallest sha256 of ``seed:vec_id``. ``rounds`` times vectors go
    to the nearest centroid and centroids to the floor of their vectors' mean; then vectors are assigned once more.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = read.schema["vec_id"].dataType
    whole = T.StructType().add("vec_id", kind).add("v", T.ArrayType(T.IntegerType()))
    assigned = T.StructType().add("cluster", T.IntegerType()).add("distance", T.LongType()).add("v", T.ArrayType(T.IntegerType())).add("vec_id", kind)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = _scaled(batch.column(1), components, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(found, components)], ["vec_id", "v"])

    def assigning(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(2).flatten().to_numpy().reshape(-1, components).astype(np.int64)
                clusters, distances = reassigned(own, batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(distances, pa.int64()), batch.column(2), batch.column(3)], assigned.names)

        return run

    kept = read.mapInArrow(scaled, whole)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("name"), "vec_id", "v").orderBy("name", "vec_id", "v").limit(k).collect()
    now = [list(r["v"]) for r in first]
    state = kept.select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), "v", "vec_id")
    if not now:
        return state.select("vec_id", "cluster", "distance"), now
    found = balls(now)
    for _ in range(rounds):
        state = stored(state.mapInArrow(assigning(spark.sparkContext.broadcast(found)), assigned), "clusters")
        sums = state.select("cluster", "distance", "v").mapInArrow(_summed(components), "cluster int, component int, s long, n long, far long")
        sums = sums.groupBy("cluster", "component").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.max("far").alias("far")).collect()
        before, now, farthest = now, [list(c) for c in now], [0] * len(now)
        for r in sums:
            now[r["cluster"]][r["component"]] = int(r["s"]) // r["n"]
            farthest[r["cluster"]] = r["far"]
        found = balls(now, before, farthest)
    last = state.mapInArrow(assigning(spark.sparkContext.broadcast(found)), assigned)
    return stored(last.select("vec_id", "cluster", "distance"), "clusters"), now


def digest(centroid: list[int]) -> str:
    """sha256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
