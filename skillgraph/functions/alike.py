"""How alike texts are to a query, with bounds that column expressions can tell before any text is compared."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of so many characters have one bit of a machine word each.
_WORD = 62


def may_reach(text: Column, query: str, share: float) -> Column:
    """Whether 2 x common characters / both lengths can be ``share`` or more.

    What two texts have in common is no longer than the shorter one, and holds no letter more often than either. Both the
    longest common subsequence and the blocks of sequence matching are bounded so.
    """
    least = F.lit(share / 2 - 1e-9) * (F.length(text) + len(query))
    shorter = F.least(F.length(text), F.lit(len(query)))
    common = F.lit(0)
    for letter, n in sorted(Counter(query).items()):
        common = common + F.least(F.lit(n), F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit(""))))
    return F.coalesce(F.when(shorter >= least, common >= least), F.lit(False))


def common_length(query: str, texts: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``query`` with each text.

    One bit for each character of the query, all texts at once: a text's next character moves, in each run of bits that are
    still set, the lowest place that has it. Each bit that is cleared in the end stands for one common character.
    """
    m = len(query)
    places: dict[str, int] = {}
    for i, letter in enumerate(query):
        places[letter] = places.get(letter, 0) | 1 << i
    if m > _WORD:  # longer than a word: whole numbers of Python, a text at a time
        out = []
        for text in texts:
            free = (1 << m) - 1
            for letter in text:
                hit = free & places.get(letter, 0)
                free = (free + hit | free - hit) & (1 << m) - 1
            out.append(m - free.bit_count())
        return np.array(out, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, at = np.unique(codes, return_inverse=True)
    hits = np.array([places.get(chr(c), 0) for c in known.tolist()], np.uint64)[at] if len(codes) else np.empty(0, np.uint64)
    order = np.argsort(-lengths, kind="stable")  # so that texts that go on stand first
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    every = np.uint64((1 << m) - 1)
    free = np.full(len(texts), every)
    for k in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -k, side="left"))  # texts with more than k characters
        hit = free[:n] & hits[starts[:n] + k]
        free[:n] = (free[:n] + hit | free[:n] - hit) & every
    found = np.empty(len(texts), np.int64)
    found[order] = m - np.bitwise_count(free)
    return found


@F.pandas_udf(T.DoubleType())
def indel_ratio(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """200 times the longest common subsequence over both lengths; two empty texts are alike."""
    out = np.zeros(len(texts))
    for query in queries.unique():
        at = np.flatnonzero(queries == query)
        own = texts.iloc[at].tolist()
        both = np.array([len(t) for t in own]) + len(query)
        out[at] = np.where(both > 0, 200.0 * common_length(query, own) / np.maximum(1, both), 100.0)
    return pd.Series(out)
