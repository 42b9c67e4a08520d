"""What followed a context elsewhere in the corpus: counts of (context, symbol) that grow with the input.

A context is the hash of the ``WORDS`` words before a token. Tokens are dealt out by their contexts, in
blocks whose number follows from the number of tokens, so each block holds all tokens of its contexts, training
tokens and those to be scored. There a token's counts are those of the training tokens, itself left out. The share
of a context's tokens that had this symbol is mixed with what the bit predictors gave the token, by a weight that
each block learns from its training tokens (no others), for every gate: how often a context was seen, and with how
many different symbols. What that changes of texts goes to groups of texts, in one row from a block to a group, and is
summed up there: such rows are no more for more texts, but with the groups, which a fixed number of tokens makes.

Contexts of the most frequent words alone have classes of their own in the bit predictors and are left to these. Every other
context holds a word outside them, so none is hotter than the first such word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skillgraph.llm.common import mixed

WORDS = 3
#: Tokens that one block holds on average.
BLOCK_TOKENS = 1 << 20
#: Tokens of the texts of one group on average, if that makes more groups than the session's partitions.
GROUP_TOKENS = 1 << 22
#: Tokens that are dealt out at once.
DEAL_TOKENS = 1 << 18
_GATES = 15
_STEPS = 6
_COST_BITS = 16


def contexts(own: np.ndarray, first: np.ndarray, frequent: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context hash, and whether it is counted. ``own`` are the words' hashes, ``first`` is where each text begins."""
    n = len(own)
    into = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    h, rare = np.zeros(n, np.uint64), np.zeros(n, bool)
    for back in range(1, words + 1):
        has = into >= back
        before = np.zeros(n, np.uint64)
        before[back:] = own[:-back]
        h = (h ^ np.where(has, before, 0)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        other = np.zeros(n, bool)
        other[back:] = ~frequent[:-back]
        rare |= has & other
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32), rare


def dealt(h: np.ndarray, symbol: np.ndarray, symbols: int, spent: np.ndarray, text: np.ndarray, teaches: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Rows (block, least, keys, texts, sizes), one for each block that some of the tokens lie in.

    A key holds a context's lower bits, the symbol and what the token cost, in 1024ths of a bit, 64 bits at most.
    Texts come in runs of ``sizes`` tokens; their numbers, from ``least`` on, are doubled, odd if their tokens teach.
    """
    block = ((h >> np.uint64(34)) % np.uint64(blocks)).astype(np.uint16 if blocks <= 1 << 16 else np.int64)
    order = np.argsort(block, kind="stable")
    least = int(text.min(initial=2**62)) if len(text) else 0
    block, text = block[order], ((text - least) * 2 + teaches)[order].astype(np.int32)
    keys = (h << np.uint64(int(symbols).bit_length()) | symbol.astype(np.uint64)) << np.uint64(_COST_BITS) | np.clip(np.rint(spent * 1024), 0, (1 << _COST_BITS) - 1).astype(np.uint64)
    runs = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (text[1:] != text[:-1])])) if len(block) else np.empty(0, np.intp)
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.intp)
    of_tokens, of_runs = pa.array(np.append(cut, len(block)), pa.int32()), pa.array(np.append(np.searchsorted(runs, cut), len(runs)), pa.int32())
    sizes = np.diff(np.append(runs, len(block))).astype(np.int32)
    lists = [(of_tokens, keys[order].view(np.int64)), (of_runs, text[runs]), (of_runs, sizes)]
    return pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int64)), pa.array(np.full(len(cut), least)), *(pa.ListArray.from_arrays(o, pa.array(v)) for o, v in lists)], ["block", "least", "keys", "texts", "sizes"])


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, column.type.value_type.to_pandas_dtype()), *(c.flatten().to_numpy() for c in column.chunks)])


def taken(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens in rows of ``dealt``: context and symbol, what they cost, their texts, and whether they teach."""
    table = pa.table(table)
    keys, runs = _numbers(table["keys"]).view(np.uint64), np.repeat(table["least"].to_numpy() * 2, pc.list_value_length(table["texts"]).to_numpy())
    text = np.repeat(runs + _numbers(table["texts"]), _numbers(table["sizes"]))
    return keys >> np.uint64(_COST_BITS), (keys & np.uint64((1 << _COST_BITS) - 1)) / 1024, text >> 1, (text & 1).astype(bool)


def counts(key: np.ndarray, teaches: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token, among the training tokens but itself: tokens of its context, those with its symbol, the context's different symbols."""
    order = np.argsort(key, kind="stable")
    key, own = key[order], teaches[order].astype(np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    context = key >> np.uint64(shift)
    start = np.concatenate([[True], context[1:] != context[:-1]])
    pair, group = np.cumsum(new) - 1, np.cumsum(start) - 1
    pairs = np.bincount(pair, own).astype(np.int64)
    c = np.bincount(group, own).astype(np.int64)
    different = np.bincount(group[new], pairs > 0).astype(np.int64)
    out = np.empty((3, len(key)), np.int64)
    same = pairs[pair] - own
    out[:, order] = c[group] - own, same, different[group] - (own & (same == 0))
    return out[0], out[1], out[2]


def remembered(spent: np.ndarray, seen: np.ndarray, same: np.ndarray, different: np.ndarray, teaches: np.ndarray) -> np.ndarray:
    """Bits that each token costs once what followed its context elsewhere is mixed in; ``spent`` where that was never seen."""
    gate = np.digitize(seen, [2, 3, 5, 9]) * 3 + np.clip(different, 1, 3) - 1
    p, q = np.exp2(-spent), same / np.maximum(seen, 1)
    learns = np.flatnonzero(teaches & (seen > 0))
    of, pl, ql = gate[learns], p[learns], q[learns]
    n = np.bincount(of, minlength=_GATES)
    weight = np.full(_GATES, 0.2)
    for _ in range(_STEPS):
        part = weight[of] * ql
        weight = (np.bincount(of, part / (part + (1 - weight[of]) * pl + 1e-300), _GATES) + 2) / (n + 10)
    w = weight[gate]
    return np.where(seen > 0, -np.log2((1 - w) * p + w * q + 1e-300), spent)


def groups_of(rows: np.ndarray, groups: int) -> np.ndarray:
    """The group of each text: neighbours by their numbers share one."""
    return (mixed(rows.astype(np.uint64) >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)


def mix_blocks(symbols: int, groups: int, passed: list[str]):
    """For applyInArrow by block: what mixing changes of texts' bits, in one row for each group of texts; rows of texts themselves pass on."""
    shift = int(symbols).bit_length()

    def run(table: pa.Table) -> pa.Table:
        told = table.filter(table["keys"].is_valid())
        texts = table.filter(table["keys"].is_null()).select(passed)
        texts = pa.table({"group": groups_of(texts["row"].to_numpy(), groups), "texts": pa.nulls(len(texts), pa.list_(pa.int64())), "changes": pa.nulls(len(texts), pa.list_(pa.float32()))} | {c: texts[c] for c in passed})
        key, spent, text, teaches = taken(told)
        if not len(key):
            return texts
        seen, same, different = counts(key, teaches, shift)
        some = np.flatnonzero(seen > 0)
        change = remembered(spent, seen, same, different, teaches)[some] - spent[some]
        row, at = np.unique(text[some], return_inverse=True)
        change, group = np.bincount(at, change, len(row)).astype(np.float32), groups_of(row, groups)
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[order], prepend=-1))
        offsets = pa.array(np.append(cut, len(row)), pa.int32())
        sums = {"group": pa.array(group[order][cut]), "texts": pa.ListArray.from_arrays(offsets, pa.array(row[order])), "changes": pa.ListArray.from_arrays(offsets, pa.array(change[order]))}
        made = [sums.get(f.name, pa.nulls(len(cut), f.type)) for f in texts.schema]
        return pa.concat_tables([texts, pa.Table.from_arrays([pa.chunked_array([c], f.type) for c, f in zip(made, texts.schema, strict=True)], schema=texts.schema)])

    return run


def sum_groups(passed: list[str]):
    """For applyInArrow by group: the texts' rows, with the sum of what all blocks change of each."""

    def run(table: pa.Table) -> pa.Table:
        texts = table.filter(table["texts"].is_null()).select(passed)
        told = table.filter(table["texts"].is_valid())
        row = texts["row"].to_numpy()
        order = np.argsort(row)
        change = np.zeros(len(row))
        change[order] = np.bincount(np.searchsorted(row, _numbers(told["texts"]), sorter=order), _numbers(told["changes"]), len(row))
        return texts.append_column("change", pa.array(change))

    return run


def as_rows(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batch under a wider schema, null in the columns that it lacks."""
    if len(batch):
        yield pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(len(batch), f.type) for f in schema], schema=schema)
