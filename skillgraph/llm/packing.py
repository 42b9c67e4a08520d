"""Packing of tokenised documents into fixed windows: best-fit decreasing.

``tokenize`` turns each text into pieces: a text's ids and an end id, cut into
full windows and a rest. ``pack`` places the pieces: full ones alone, the
others by best fit, longest first, where a segment tree over the remaining
capacities finds the tightest open window. Packing needs only lengths and
runs on groups of about ``group_pieces`` pieces, dealt by a hash of their numbers (so
repeated rows and ids spread too), so that any number of groups are packed side by side; a group leaves about one window
partly filled. The pieces, with their ids, then take their places in a join.

Defined cases: a null or empty text is the end id alone; a null id is kept;
repeated rows are packed each; other columns of pieces are carried along.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.llm.common import stored, text_slices

END_ID = 2
WINDOW = 4096
#: Punctuation that ends a word after a letter is always cut off by the tokenizer; apostrophes may begin a piece like 's.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[ \t-\r]|\Z)", re.DOTALL)
_encoders: dict[str, "_Encoder"] = {}


class _Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, word by word with a memory of at most ``limit`` words.

    The tokenizer never joins across white space and lower-cases, so a text's
    ids are those of its lower-cased words in a row. Texts with a special
    token's brackets are encoded as a whole.
    """

    def __init__(self, path: str, limit: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece
        self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.limit = limit
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Words of plain letters are one piece each: they are encoded in runs, and cut where pieces end."""
        plain, other = [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            (plain if text.isalpha() and text.islower() and max(text) < "\u0250" else other).append((w, text))
        for a in range(0, len(plain), 256):
            part = plain[a : a + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            raw, froms, tos = ids.tobytes(), [0, *(4 * cuts[:-1]).tolist()], (4 * cuts).tolist()
            self.known.update((w, raw[s:e]) for (w, _), s, e in zip(part, froms, tos, strict=True))
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            self.known.update(zip((w for w, _ in part), self._ids([t for _, t in part]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [None if b"<|" in t else _TAIL.sub(rb" \g<0>", t.lower()).split() for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        self._learn(list(set().union(*filter(None, words)).difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) if ws is not None else self._ids([t.decode("utf-8", "replace")])[0] for ws, t in zip(words, texts, strict=True)]


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""
    key = docs.schema[id_column].dataType
    schema = T.StructType().add("doc_id", key).add("start", T.LongType()).add("length", T.LongType()).add("doc_tokens", T.LongType()).add("ids", T.BinaryType())
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for first, after, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                row, start, total, ids = [], [], [], []
                for i, one in enumerate(encoder.encode(texts)):
                    one += last
                    for a in range(0, len(one), 4 * window):
                        row.append(first + i)
                        start.append(a // 4)
                        total.append(len(one) // 4)
                        ids.append(one[a : a + 4 * window])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    [f.name for f in schema.fields],
                )

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class _Windows:
    """Open windows by remaining capacity, under a segment tree that tells which capacities have any."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        if not capacity:
            return
        self.open[capacity].append(sequence)
        node = capacity + self.leaves
        while node:
            self.tree[node] += 1
            node >>= 1

    def tightest(self, length: int) -> int:
        """The least capacity >= length with an open window, or -1."""
        node = length + self.leaves
        if self.tree[node]:
            return length
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node *= 2
            if not self.tree[node]:
                node += 1
        return node - self.leaves

    def take(self, capacity: int) -> int:
        node = capacity + self.leaves
        while node:
            self.tree[node] -= 1
            node >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (0, 1, ...) and the offset of each piece; lengths of 1 to ``window``, longest first."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, n = _Windows(window), 0
    for i, length in enumerate(lengths.tolist()):
        capacity = windows.tightest(length)
        if capacity < 0:
            sequence[i], capacity = n, window
            n += 1
        else:
            sequence[i] = windows.take(capacity)
        offset[i] = window - capacity
        windows.add(capacity - length, int(sequence[i]))
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = 16_384) -> DataFrame:
    """``pieces`` (doc_id, start, length and any others) with sequence_id and offset.

    Groups are numbered, and a sequence's number is group * 2^32 + its place there.
    """
    pieces = stored(pieces.withColumn("_piece_", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType().add("_piece_", T.LongType()).add("sequence_id", T.LongType()).add("offset", T.LongType())

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        return pd.DataFrame({"_piece_": group["_piece_"], "sequence_id": (int(key[0]) << 32) + sequence, "offset": offset})

    lengths = pieces.select("_piece_", "doc_id", "start", "length", F.pmod(F.xxhash64("_piece_"), F.lit(groups)).alias("_group_"))
    return pieces.join(lengths.groupBy("_group_").applyInPandas(run, schema), "_piece_").drop("_piece_")
