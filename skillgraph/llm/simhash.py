"""SimHash near-duplicates by segment popcounts, a grid join and exact verification.

1. A text's fingerprint has a bit where over half the XXH64 hashes of its word
   shingles have it. Equal fingerprints are one from here on.
2. Each fingerprint is embedded as 32 counts, the bits set in each of its
   2-bit segments. The Manhattan distance of two embeddings is a lower bound of
   the Hamming distance of the fingerprints.
3. The segments are cut into ``radius + keep`` blocks. Two embeddings within
   Manhattan distance ``radius`` agree in at least ``keep`` whole blocks, so
   they share a cell of the grid that some ``keep`` blocks span: the range
   join is an equi-join on (blocks, counts in them). ``keep`` follows the number
   of fingerprints, so that cells stay small at any size.
4. Within a cell, pairs under the lower bound are verified exactly, and a
   spanning forest of the links is passed on; the links' components are those
   of all links. Cells are counted first; one of more than ``tile`` fingerprints
   is cut into pairs of tiles before it is dealt out, so that no task gathers it.

Defined cases: a text without words has fingerprint zero and links like any
other; null is empty; repeated rows each have a row; a null id can't be a
component's least id unless it is alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import in_tiles, lower_bytes, row_keys, stored, text_slices
from skillgraph.llm.components import components

SEED = 42
_PAIRS = np.uint64(0x5555555555555555)


def _fingerprint(shingles: list[bytes]) -> int:
    """Bits that are set in over half the hashes; one's complement where the top bit is set, as Spark's long."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h)).view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, k1, k2, fp) of each row: its id, its keys, and a long with the fingerprint's bits."""
    schema = T.StructType().add("doc_id", docs.schema[id_column].dataType).add("k1", T.LongType()).add("k2", T.LongType()).add("fp", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int] = []
            for _, _, data, offsets in text_slices(batch.column(3)):
                raw = lower_bytes(data).tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = raw[a:b].split()
                    if not words:
                        out.append(0)
                        continue
                    joined = b" ".join(words)
                    n = max(1, len(words) - shingle + 1)
                    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
                    ends = np.cumsum(lengths)
                    starts = (ends - lengths)[:n].tolist()
                    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
                    out.append(_fingerprint([joined[s:e] for s, e in zip(starts, stops, strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], schema.names)

    k1, k2 = row_keys(id_column, text)
    return docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text")).mapInArrow(run, schema)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: counts of set bits of the 32 two-bit segments, two bits each."""
    return fp - ((fp >> np.uint64(1)) & _PAIRS)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of two embeddings' fields (each 0, 1 or 2).

    A field as a run of ones (0, 1, 11) makes the difference of counts a number of differing bits.
    """
    return np.bitwise_count(a ^ b)


def _unary(counts: np.ndarray) -> np.ndarray:
    """Fields 0, 1, 2 as 00, 01, 11."""
    return counts | ((counts >> np.uint64(1)) & _PAIRS)


def block_masks(radius: int, keep: int) -> list[int]:
    """For each choice of ``keep`` of ``radius + keep`` blocks of segments, the mask of their bits."""
    edges = [round(32 * i / (radius + keep)) for i in range(radius + keep + 1)]
    blocks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, keep)]


def _links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a (or of a and b): lower bound first, then the exact distance."""
    left, right = [], []
    other = a if b is None else b
    ua, uo = _unary(popcounts(a)), _unary(popcounts(other))
    step = max(1, (1 << 20) // max(1, len(other)))
    for s in range(0, len(a), step):
        near = _manhattan(ua[s : s + step, None], uo[None, :]) <= radius
        if b is None:
            near &= np.arange(s, min(len(a), s + step))[:, None] < np.arange(len(a))[None, :]
        i, j = np.nonzero(near)
        exact = np.bitwise_count(a[i + s] ^ other[j]) <= radius
        left.append(a[i[exact] + s])
        right.append(other[j[exact]])
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every end to the least one it is joined with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _groups(radius: int):
    """Reads rows (part, cell, i, j, own, fp) ordered by all but the last: edges of a forest of each group's links."""

    def joined(first: int, second: int, group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, fp = (np.concatenate(x) for x in zip(*group, strict=True))
        left, right = (fp, None) if first == second else (fp[own == first], fp[own == second])
        if not len(left) or (right is not None and not len(right)):
            return
        a, b = _links(left, right, radius)
        if len(a):
            x, y = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, own, fp = (batch.column(i).to_numpy() for i in range(6))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            sizes = np.diff(bounds)
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist():
                a, b = bounds[k], bounds[k + 1]
                key = tuple(x[a] for x in keys)
                if key != last and held:
                    if sum(len(x) for x, _ in held) > 1:
                        yield from joined(last[2], last[3], held)
                    held = []
                last = key
                held.append((own[a:b].copy(), fp[a:b].copy()))
        if sum(len(x) for x, _ in held) > 1:
            yield from joined(last[2], last[3], held)

    return run


def links(distinct: DataFrame, radius: int = 4, keep: int | None = None, tile: int = 2048) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all pairs within ``radius``. ``distinct``: fp."""
    if keep is None:
        size = max(2, distinct.count())
        keep = next((k for k in range(3, 7) if 48 * k / (radius + k) >= math.log2(size)), 7)  # 1.5 bits a segment
    masks = block_masks(radius, keep)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    embedded = distinct.select("fp", _popcount_column().alias("counts"))
    cells = embedded.select("fp", F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m in signed])).alias("part", "cell")).select(F.col("part").cast("int").alias("part"), "cell", "fp")
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["part", "cell", "i", "j"]
    dealt = in_tiles(cells, ["part", "cell"], "fp", tile).repartition(partitions, *group).sortWithinPartitions(*group, "own", "fp")
    return dealt.select(*group, "own", "fp").mapInArrow(_groups(radius), "a long, b long").distinct()


def _popcount_column():
    """The embedding as an expression on fp. Fields of fp (2 bits: 00, 01, 10, 11) become 0, 1, 1, 2 without borrow across fields."""
    low = F.col("fp").bitwiseAND(F.lit(int(_PAIRS)))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(int(_PAIRS)))
    both = low.bitwiseAND(high)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(both, 1))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, k1, k2, root): component_id is the least id that links of ``radius`` differing bits or fewer reach.

    k1 and k2 are the row's keys; root names its component, by its least fingerprint as a long.
    """
    prints = stored(fingerprints(docs, id_column, text, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(rooted, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "k1", "k2", "root")


def others(found: DataFrame) -> DataFrame:
    """(k1, k2) of the rows that ``near_duplicates`` found and that aren't the first of their component: by id (null last), then by keys."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    return found.join(first, "root").where((F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2"))).select("k1", "k2").distinct()
