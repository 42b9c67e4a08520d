"""Pairs of numbered entities that meet in lists, added up and ranked as arrays within a task of Spark's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are put together at once; beyond these, what a task has read is added up before it reads on.
HELD = 4_000_000


def _bits(most: int) -> int:
    return max(1, int(most).bit_length())


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray | None, v: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Pairs (a, b) in order, each once, with how often it came (n: already that often) and the sum of its values."""
    if not len(a):
        return a, b, np.zeros(0, np.int64), v
    low_a, low_b = int(a.min()), int(b.min())
    width = _bits(int(b.max()) - low_b)
    if _bits(int(a.max()) - low_a) + width > 63:  # numbers too far apart for one key: their places among the present ones
        (names_a, at), (names_b, bt) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        i, j, n, v = _added(at, bt, n, v)
        return names_a[i], names_b[j], n, v
    key = (a - low_a) << width | (b - low_b)
    low_v = int(v.min()) if v is not None else 0
    room = _bits(int(v.max()) - low_v) if v is not None else 0
    if n is None and _bits(int(key.max())) + room <= 63:  # values fit below the keys, so that sorting takes them along
        if v is not None:
            key = key << room | (v - low_v)
        key.sort()
        if v is not None:
            v, key = (key & ((1 << room) - 1)) + low_v, key >> room
    else:
        order = np.argsort(key)
        key = key[order]
        n, v = (None if x is None else x[order] for x in (n, v))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(start, len(key))) if n is None else np.add.reduceat(n, start)
    key = key[start]
    return (key >> width) + low_a, (key & ((1 << width) - 1)) + low_b, n, None if v is None else np.add.reduceat(v, start)


def met(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(a, b, n, v) of rows (a, bs[, w, vs][, many]): every b that a met, how often, and the sum of the lesser weights.

    With ``many``, a meets itself only where that says so.
    """
    waiting, total = [], None

    def put() -> tuple:
        parts = [_added(*(None if x[0] is None else np.concatenate(x) for x in zip(*waiting, strict=True)))] if waiting else []
        parts += [total] if total else []
        waiting.clear()
        return parts[0] if len(parts) == 1 else _added(*(None if x[0] is None else np.concatenate(x) for x in zip(*parts, strict=True)))

    held = 0
    for batch in batches:
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
        sizes = batch.column("bs").value_lengths().to_numpy(zero_copy_only=False)
        a, b, v = np.repeat(number("a").astype(np.int64), sizes), flat("bs"), None
        if "w" in batch.schema.names:
            v = np.minimum(np.repeat(number("w").astype(np.int64), sizes), flat("vs"))
        if "many" in batch.schema.names:
            fit = (a != b) | np.repeat(number("many").astype(bool), sizes)
            a, b, v = a[fit], b[fit], None if v is None else v[fit]
        waiting.append((a, b, None, v))
        held += len(a)
        if held > HELD:
            total, held = put(), 0
    if not waiting and total is None:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return put()


def _texts(b: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Numbers that are in the order of the numbers ``b`` as texts, and what turns them back."""
    digits = len(str(int(b.max())))
    if int(b.min()) >= 0 and digits <= 16:  # filled up with zeros; of equal ones the shorter is less
        tens = 10 ** np.arange(digits, dtype=np.int64)
        own = np.zeros(len(b), np.int8)  # digits but one
        for ten in tens[1:]:
            own += b >= ten
        return b * (tens[::-1] * digits)[own] + own, lambda t: t // digits // tens[::-1][t % digits]
    names, at = np.unique(b, return_inverse=True)
    order = np.argsort(names.astype("U20"))
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return place[at], lambda t: names[order[t]]


def _best(a: np.ndarray, b: np.ndarray, value: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, value, rank) of the ``room`` greatest values of each a (all if 0), of equal ones the least b as text. ``a`` is in order."""
    first = np.concatenate([[True], a[1:] != a[:-1]])
    start, most = np.flatnonzero(first), int(value.max())
    group, less, (text, back) = np.cumsum(first) - 1, most - value, _texts(b)
    rank = np.arange(1, len(a) + 1) - np.repeat(start, np.diff(np.append(start, len(a))))
    kept = np.flatnonzero(rank <= room) if room > 0 else np.arange(len(a))
    low = int(text.min())
    widths = [_bits(int(group[-1])), _bits(int(less.max())), _bits(int(text.max()) - low)]
    if sum(widths) <= 63:  # all that makes the order in one number, which is sorted and read back
        key = (group << widths[1] | less) << widths[2] | (text - low)
        key.sort()
        key = key[kept]
        text, less = (key & ((1 << widths[2]) - 1)) + low, key >> widths[2] & ((1 << widths[1]) - 1)
    else:
        order = np.lexsort((text, less, group))[kept]
        text, less = text[order], less[order]
    return a[kept], back(text), most - less, rank[kept]


def ranked(batches: Iterable[pa.RecordBatch], scores: list[str], room: int, threshold: float, unit: float) -> Iterator[pa.RecordBatch]:
    """(a, neighbor, value, rank, method) of the best neighbours by each score; ``unit``: what a weighted score is divided by for the threshold."""
    a, b, n, v = met(batches)
    for m in scores:
        value = n if m == "unweighted" else v
        fit = np.flatnonzero((value if m == "unweighted" else value / unit) >= threshold)
        if len(fit):
            own, neighbor, best, rank = _best(a[fit], b[fit], value[fit], room)
            columns = [pa.array(x) for x in (own, neighbor, best, rank.astype(np.int32))] + [pa.array([m]).take(pa.array(np.zeros(len(own), np.int8)))]
            yield from pa.Table.from_arrays(columns, ["a", "neighbor", "value", "rank", "method"]).to_batches(max_chunksize=100_000)


def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared_count, weighted_score) of every pair, in order."""
    a, b, n, v = met(batches)
    if len(a):
        yield from pa.Table.from_arrays([pa.array(x) for x in (a, b, n, v)], ["a", "b", "shared_count", "weighted_score"]).to_batches(max_chunksize=100_000)
