"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skillgraph.storage import stored as stored

#: Texts are handled in slices of about so many bytes, so that temporaries stay small.
SLICE_BYTES = 1 << 20


def row_keys(id_column: str, text: str) -> tuple[Column, Column]:
    """Two longs that tell rows apart by id and text: rows of one id (null too) with other texts have other keys.

    They depend on the row's content alone, so a task that runs again gives them again. Rows with the same id and the same
    text have the same keys; 128 bits make equal keys of others a matter of 10^-18 among 10^10 rows.
    """
    seen, flags = (F.col(id_column), F.col(text)), F.concat(F.col(id_column).isNull().cast("string"), F.col(text).isNull().cast("string"))
    return F.xxhash64(*seen, flags), F.xxhash64(F.lit(0x5DEECE66D), *reversed(seen), flags)


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % divisor


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` is quicker and the same where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(column.rlike("[^\\x00-\\x7F]"), F.translate(column, upper, upper.lower())).otherwise(F.lower(column))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes; null is empty.

    A longer text is a run of its own: memory is bounded by the longest text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z as a-z."""
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and where each text's words begin among them.

    ``table`` tells which bytes stand in words; by default the words are ``[^\\x20\\x09-\\x0D]+``.
    """
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.take(table, data, out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.cumprod(table, dtype=np.uint64)
    return table[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of values[start:end], modulo 2^64: differences of prefix sums, shifted to a common power."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power_table(_BASE, n), out=prefix[1:])
    return mixed((prefix[ends] - prefix[starts]) * _power_table(pow(_BASE, -1, 1 << 64), n + 1)[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hashes(_BYTE_KEYS[data], starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words, across text borders too: the caller leaves those out."""
    at = np.arange(max(0, len(words) - size + 1))
    return span_hashes(words, at, at + size)


def decoded(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of a slice."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def char_grams(texts: list[str], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of lower-cased texts, one after another, and where each text's begin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < n:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(lengths)
    h = np.full(len(codes) - n + 1, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    counts = np.maximum(lengths - n + 1, 0)
    if n > 1 and len(texts) > 1:
        keep = np.ones(len(h) + n, bool)
        for k in range(1, n):
            at = ends[:-1] - k
            keep[at[at >= 0]] = False
        h = h[keep[: len(h)]]
    starts = np.concatenate([[0], np.cumsum(counts)])
    return h, starts


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]] along the first axis; empty runs give zero."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def in_tiles(rows: DataFrame, keys: list[str], by: str, tile: int, broadcast_rows: int = 500_000) -> DataFrame:
    """``rows`` with columns i, j and own, in groups by ``keys``, i and j that hold about two times ``tile`` rows at most.

    A group of ``keys`` with up to ``tile`` rows stays as it is (0, 0, 0). A larger one is cut into tiles by a hash of
    ``by``, and a row is there once for each pair i <= j of tiles with its own. Where i = j all rows are to meet, else those
    of tile i with those of tile j: so every two rows of a group meet once, and no task gathers a group.
    """
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n_")).where(F.col("_n_") > tile).withColumn("_n_", F.ceil(F.col("_n_") / tile).cast("int")), "large")
    none = F.lit(0)
    n = large.count()
    if not n:
        return rows.select("*", none.alias("i"), none.alias("j"), none.alias("own"))
    found = F.broadcast(large) if n <= broadcast_rows else large
    few = rows.join(found.drop("_n_"), keys, "left_anti").select(*rows.columns, none.alias("i"), none.alias("j"), none.alias("own"))
    many = rows.join(found, keys).withColumn("own", F.pmod(F.xxhash64(by), F.col("_n_")).cast("int"))
    many = many.withColumn("_other_", F.explode(F.sequence(none, F.col("_n_") - 1)))
    return few.unionByName(many.select(*rows.columns, F.least("own", "_other_").alias("i"), F.greatest("own", "_other_").alias("j"), "own"))
