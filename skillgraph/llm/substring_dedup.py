"""Removal of passages that occur more than once, by Rabin-Karp hashes of all windows of words.

A window is ``size`` consecutive words of one text. Words covered by a window
whose word sequence starts anywhere else too are removed.

Hashing and counting every window would shuffle a row per word. So windows
are first sorted out exactly: each has an anchor, the gram of ``gram`` words
with the least hash in it, and equal windows have equal anchors. One in about
``(size - gram) / 2`` words begins an anchor. Spark counts the anchors; only
windows whose anchor occurs more than once, that is, all that can be repeated
and few others, are then hashed whole and counted. The few of them that turn out
single go back to their rows; all others are repeated, and merge into maximal
intervals. All counts are summed before they are shuffled. Anchors that make up more
than one in ``1 / hot`` of all occurrences are at most that many: they are broadcast,
and only the others meet their occurrences in a shuffle.

Defined cases: a null or short text has no window; repeated rows repeat all
their windows and get a row each; rows are told apart by id and text, so rows that
share an id (null too) but not a text are cleaned each by its own windows; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import find_words, row_keys, stored, text_slices, window_hashes, word_hashes

_PLACE = np.uint64((1 << 24) - 1)
_KEYS = T.StructType().add("k1", T.LongType()).add("k2", T.LongType())


def _anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: word hashes, each text's first word, gram hashes, the first words of all windows and their anchors'."""
    starts, ends, first = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    last_start = first[1:] - size  # of each text
    window = np.flatnonzero(np.arange(len(words)) <= np.repeat(last_start, counts))
    if not len(window):
        return words, first, np.empty(0, np.uint64), window, window
    grams = window_hashes(words, gram)
    span = size - gram + 1
    # The least hash and, of equal ones, the leftmost: the place stands in the low bits.
    best = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: -(span - width)], best[span - width :])
    place = (best[window] & _PLACE).astype(np.int64)
    return words, first, grams, window, place + ((window - place) >> 24 << 24) * (len(grams) >> 24 > 0)


def _row_keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    at = pa.array(rows)
    return [batch.column("k1").take(at), batch.column("k2").take(at)]


def _anchor_rows(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in text_slices(batch.column("text")):
                _, first, grams, window, anchor = _anchors(data, offsets, size, gram)
                if not len(window):
                    continue
                new = np.ones(len(anchor), bool)
                new[1:] = anchor[1:] != anchor[:-1]
                at = anchor[new]
                row = np.searchsorted(first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([*_row_keys(batch, begin + row), pa.array(grams[at].view(np.int64)), pa.array((at - first[row]).astype(np.int32))], ["k1", "k2", "anchor", "place"])

    return run


def _flat(lists: pa.Array, begin: int, end: int, first: np.ndarray) -> np.ndarray:
    """The numbers that the rows' lists hold, counted from the texts' first words."""
    held = lists.offsets.to_numpy()
    return np.repeat(first[:-1], np.diff(held[begin : end + 1])) + lists.values.to_numpy()[held[begin] : held[end]]


def _marked(words: np.ndarray, window: np.ndarray, anchor: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The windows whose anchor is one of ``own``."""
    marked = np.zeros(len(words) + 1, bool)
    marked[own] = True
    return window[marked[anchor]]


def _window_rows(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in text_slices(batch.column("text")):
                words, first, _, window, anchor = _anchors(data, offsets, size, gram)
                at = _marked(words, window, anchor, _flat(batch.column("places"), begin, end, first))
                if not len(at):
                    continue
                row = np.searchsorted(first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([*_row_keys(batch, begin + row), pa.array(window_hashes(words, size)[at].view(np.int64)), pa.array((at - first[row]).astype(np.int32))], ["k1", "k2", "window", "start"])

    return run


def _cleaned(size: int, gram: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for begin, end, data, offsets in text_slices(batch.column(1)):
                words, first, _, window, anchor = _anchors(data, offsets, size, gram)
                at = np.setdiff1d(_marked(words, window, anchor, _flat(batch.column(2), begin, end, first)), _flat(batch.column(3), begin, end, first), assume_unique=True)
                cut = np.searchsorted(at, first)
                raw = data.tobytes()
                for i in range(end - begin):
                    own = raw[offsets[i] : offsets[i + 1]].split()
                    starts = at[cut[i] : cut[i + 1]] - first[i]
                    breaks = np.flatnonzero(np.diff(starts) > size) + 1
                    froms = starts[np.concatenate([[0], breaks])].tolist() if len(starts) else []
                    tos = (starts[np.concatenate([breaks - 1, [-1]])] + size).tolist() if len(starts) else []
                    n_words.append(len(own))
                    n_removed.append(sum(tos) - sum(froms))
                    for s, e in zip(reversed(froms), reversed(tos), strict=True):
                        del own[s:e]
                    kept.append(b" ".join(own).decode("utf-8", "replace"))
                    spans.append([{"start": s, "stop": e} for s, e in zip(froms, tos, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names)

    return run


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 35, gram: int = 12, hot: float = 1e-4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), spans (removed word intervals)."""
    k1, k2 = row_keys(id_column, text)
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    texts, keys = docs.select("k1", "k2", "text"), ["k1", "k2"]
    anchors = stored(texts.mapInArrow(_anchor_rows(size, gram), T.StructType([*_KEYS.fields]).add("anchor", T.LongType()).add("place", T.IntegerType())), "anchors")
    repeated = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    most = F.lit(hot * max(1, anchors.count()))
    often, seldom = (repeated.where(w).select("anchor") for w in (F.col("n") > most, F.col("n") <= most))
    found = anchors.join(F.broadcast(often), "anchor", "left_semi").unionByName(anchors.join(F.broadcast(often), "anchor", "left_anti").join(seldom, "anchor", "left_semi"))
    places = found.groupBy(*keys).agg(F.array_sort(F.collect_set("place")).alias("places"))
    none = F.array().cast("array<int>")
    marked = docs.join(places, keys, "left").select("doc_id", *keys, "text", F.coalesce("places", none).alias("places"))
    # All columns stay, so that the texts are shuffled once for both uses.
    windows = marked.where(F.size("places") > 0).mapInArrow(_window_rows(size, gram), T.StructType([*_KEYS.fields]).add("window", T.LongType()).add("start", T.IntegerType()))
    single = windows.groupBy("window").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("k1", "k2", "start")]).where("n = 1")
    singles = single.groupBy(*keys).agg(F.collect_set("start").alias("singles"))
    schema = T.StructType([docs.schema["doc_id"]]).add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_text", T.StringType()).add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("stop", T.LongType())))
    joined = marked.join(singles, keys, "left").select("doc_id", "text", "places", F.coalesce("singles", none).alias("singles"))
    return joined.mapInArrow(_cleaned(size, gram, [f.name for f in schema.fields]), schema)
