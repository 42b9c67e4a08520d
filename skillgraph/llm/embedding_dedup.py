"""Near-duplicate vectors by spherical-cap filters.

1. Equal vectors of one label are one, with a count.
2. Filters are sums of one random unit vector for each block of dimensions (a
   random product code). A vector is decoded to all filters whose inner
   product with it exceeds a threshold: block products are sorted, and only the
   best of each block can take part. The code grows with the number of
   vectors, so that filters hold few vectors at any size, and the threshold
   follows from the wanted length of the lists.
3. Vectors meet by (label, filter). Pairs are verified in double precision.
   A pair that meets in several filters counts in the least common one, so
   links are counted, not listed; a spanning forest of a filter's links is passed on.
   Filters are counted first; one of more than ``tile`` vectors is cut into pairs
   of tiles before it is dealt out, so that no task gathers it.

Defined cases: a null id, label or vector, a zero vector and one with null or
non-finite components link with nothing and stay; vectors of different lengths
never link; repeated rows are vectors of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import in_tiles, stored
from skillgraph.llm.components import components
from skillgraph.llm.simhash import forest

#: Besides those over the threshold, a vector's best filters up to so many.
LEAST = 6


def codebook(dimensions: int, words: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors for the two halves of the dimensions."""
    draw = np.random.default_rng([seed, dimensions, words])
    halves = [draw.standard_normal((words, n)) for n in (dimensions // 2, dimensions - dimensions // 2)]
    return tuple(h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-30) for h in halves)


def decode(unit: np.ndarray, book: tuple[np.ndarray, np.ndarray], threshold: float) -> list[np.ndarray]:
    """For each unit vector, the numbers of all filters over the threshold, ascending."""
    first, second = book
    words = len(first)
    left, right = unit[:, : first.shape[1]] @ first.T, unit[:, first.shape[1] :] @ second.T
    out: list[np.ndarray] = []
    for a, b in zip(left, right, strict=True):
        top = 32
        while True:
            # If (i, j) exceeds, so do all pairs of better ones: with fewer than top pairs none lies beyond the best top.
            top = min(top, words)
            i = np.argpartition(-a, top - 1)[:top]
            j = np.argpartition(-b, top - 1)[:top]
            sums = a[i][:, None] + b[j][None, :]
            least = np.partition(sums, -LEAST, axis=None)[-LEAST] if sums.size > LEAST else sums.min()
            x, y = np.nonzero(sums >= min(threshold, least))
            if len(x) < top or top == words:
                break
            top *= 2
        out.append(np.sort(i[x] * words + j[y]))
    return out


def _linked(own: int, left: tuple, right: tuple | None, least: float) -> pa.RecordBatch | None:
    """Rows (a, b, n): edges of a spanning forest where b is given, else n more links of a."""
    ids, counts, filters, vectors = left
    ids2, counts2, filters2, vectors2 = left if right is None else right
    links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
    ea, eb = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // len(ids2))
    for s in range(0, len(ids), step):
        near = vectors[s : s + step] @ vectors2.T >= least
        if right is None:
            near &= np.arange(s, min(len(ids), s + step))[:, None] < np.arange(len(ids))[None, :]
        i, j = np.nonzero(near)
        i += s
        ea.append(ids[i])
        eb.append(ids2[j])
        for c in range(0, len(i), 1 << 13):
            x, y = i[c : c + (1 << 13)], j[c : c + (1 << 13)]
            f = filters[x]
            common = (f[:, :, None] == filters2[y][:, None, :]).any(axis=2) & (f >= 0)
            first = np.where(common, f, np.iinfo(np.int64).max).min(axis=1) == own
            np.add.at(links, x[first], counts2[y[first]])
            np.add.at(links2, y[first], counts[x[first]])
    a, b = np.concatenate(ea), np.concatenate(eb)
    if not len(a):
        return None
    a, b = forest(a, b)
    n, n2 = np.flatnonzero(links), np.flatnonzero(links2)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([a, ids[n], ids2[n2]])), pa.array([*b.tolist(), *[None] * (len(n) + len(n2))], pa.int64()), pa.array(np.concatenate([np.zeros(len(a), np.int64), links[n], links2[n2]]))], ["a", "b", "n"]
    )


def _filter_rows(book_size: int, least_lists: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            width = pc.list_value_length(vectors).to_numpy()
            flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            at = vectors.offsets.to_numpy()
            for d in np.unique(width).tolist():
                book = codebook(d, book_size)
                threshold = NormalDist().inv_cdf(1 - least_lists / book_size**2) / np.sqrt(d / 2) if d else 0.0
                rows = np.flatnonzero(width == d)
                for r in range(0, len(rows), 1024):
                    some = rows[r : r + 1024]
                    raw = flat[at[some][:, None] + np.arange(d)]
                    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    lists = decode(unit, book, threshold)
                    own = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(own), pa.array(width[some], pa.int32()), batch.column("least").take(own), batch.column("copies").take(own), pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), pa.array([x.tobytes() for x in unit], pa.binary())],
                        ["label", "width", "id", "copies", "filters", "vector"],
                    )

    return run


def _groups(least: float):
    """Reads rows ordered by (label, width, filter, i, j)."""
    keys = ("label", "width", "filter", "i", "j")

    def group_work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        filter_, first, second = (rows.column(c)[0].as_py() for c in ("filter", "i", "j"))
        lists = rows.column("filters").to_pylist()
        filters = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for i, x in enumerate(lists):
            filters[i, : len(x)] = x
        vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(lists), -1)
        all_ = (rows.column("id").to_numpy(), rows.column("copies").to_numpy(), filters, vectors)
        own = rows.column("own").to_numpy()
        left, right = (all_, None) if first == second else (tuple(x[own == t] for x in all_) for t in (first, second))
        if len(left[0]) and (right is None or len(right[0])):
            found = _linked(filter_, left, right, least)
            if found is not None:
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for name in keys:
                c = batch.column(name)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                if held:
                    new[0] |= held[-1].column(name)[held[-1].num_rows - 1] != c[0]
            new[0] |= not held
            bounds = [*np.flatnonzero(new).tolist(), n]
            if bounds[0] > 0:
                held.append(batch.slice(0, bounds[0]))
            for a, b in zip(bounds, bounds[1:], strict=False):
                if held and sum(x.num_rows for x in held) > 1:
                    yield from group_work(pa.Table.from_batches(held))
                held = [batch.slice(a, b - a)]
        if held and sum(x.num_rows for x in held) > 1:
            yield from group_work(pa.Table.from_batches(held))

    return run


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, lists: float = 12.0, tile: int = 1024) -> DataFrame:
    """id, n_links, component_id, kept for every row; links: cosine >= ``least`` in one label. Ids are integers."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("usable", usable)
    distinct = stored(marked.where("usable").groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "vectors")
    size = max(2, distinct.count())
    words = int(np.ceil(np.sqrt(size * lists / 6))) + 32
    schema = T.StructType().add("label", rows.schema["label"].dataType).add("width", T.IntegerType()).add("id", T.LongType()).add("copies", T.LongType()).add("filters", T.ArrayType(T.LongType())).add("vector", T.BinaryType())
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decoded = stored(distinct.repartition(partitions, "least").mapInArrow(_filter_rows(words, lists), schema), "decoded")
    met = in_tiles(decoded.select("*", F.explode("filters").alias("filter")), ["label", "width", "filter"], "id", tile)
    group = ["label", "width", "filter", "i", "j"]
    dealt = met.repartition(partitions, *group).sortWithinPartitions(*group, "id")
    found = stored(dealt.mapInArrow(_groups(least), "a long, b long, n long"), "links")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "least")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "least")
    known = distinct.join(counts, "least", "left").join(roots, "least", "left").select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "least").alias("component_id"))
    done = marked.where("usable").join(known, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = marked.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
