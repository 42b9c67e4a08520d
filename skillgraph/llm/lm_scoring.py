"""Language-model scores by online logistic context mixing.

Text is a run of tokens: its lower-cased words and an end. A token is coded as
bits, and each bit is predicted by mixed context predictors (see ``bitmix``):

* The ``vocabulary`` most frequent words (and an escape) have codes by weight. Contexts
  are the classes of the word before, of the two before and of the second before.
  The prior is the words' frequency.
* Any other word is the escape and its spelling, byte by byte, under contexts of the
  last two, three and four bytes; or, at half the weight, its own frequency.
* What followed the three words before elsewhere in the training texts is mixed in
  token by token (see ``memory``); these counts grow with the input.

Counts of words, of all contexts and of spellings cover all training texts.
Mixing weights and the refining map are learned online on all training texts (and
words), each half of them predicted from the other half's counts. So are these texts when they are
scored, so that no table holds what it predicts; other texts have the counts of both. While a text is
scored, its own weights go on adapting, from one run of ``RUN`` tokens to the next.

The vocabulary and the tables have fixed sizes and are broadcast; rare words are
counted and spelled once each, and meet their texts in a join. Contexts of three words are
counted where their tokens are dealt to, in as many blocks as there are tokens for.
A training text's own tokens are left out of these, and of how often a rare word was seen, one at a time, so only what
stands elsewhere helps it. The vocabulary and its codes hold all training tokens, its own too.

Defined cases: a null or empty text is the end alone; without training texts
every count is 0; repeated rows are scored (and counted) each; a null id
counts as the empty text in the folds; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skillgraph.llm.bitmix import DEPTHS, Bits, Mixer, Trained, cost, inputs, mixed_logit, refined_logit, trained
from skillgraph.llm.common import find_words, lower_bytes, remainder, stored, text_slices, word_hashes
from skillgraph.llm.memory import BLOCK_TOKENS, DEAL_TOKENS, GROUP_TOKENS, as_rows, contexts, dealt, mix_blocks, sum_groups
from skillgraph.storage import tasks_for

VOCABULARY = 1 << 17
OWN_CLASS = 512  # so many words are contexts of their own
TABLE_BITS = 20
SLICE = 1 << 17
COUNTED = 1 << 17  # bytes of text whose bits are counted at once
SPELL_BITS = 20
RUN = 256
TEXT_COLUMNS = ["row", "doc_id", "part", "n_tokens", "n_known", "logs", "coded", "n_bytes", "rare"]
_END = b""
_BREAK = 0x20  # ends a spelling; no word holds it


@dataclass(frozen=True)
class Vocabulary:
    """Symbol 0 is the escape; a word's symbol is found by its hash in an open table."""

    keys: np.ndarray
    symbols: np.ndarray
    longest: int
    counts: np.ndarray
    end: int
    code_start: np.ndarray
    code_node: np.ndarray
    code_bit: np.ndarray
    code_logit: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        at = (hashes & mask).astype(np.intp)
        out = np.where(self.keys[at] == hashes, self.symbols[at], 0)
        open_ = np.flatnonzero((self.keys[at] != hashes) & (self.symbols[at] > 0))
        for _ in range(self.longest):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & int(mask)
            k = at[open_]
            hit = self.keys[k] == hashes[open_]
            out[open_[hit]] = self.symbols[k[hit]]
            open_ = open_[~hit & (self.symbols[k] > 0)]
        return out


def _hash_of(words: list[bytes]) -> np.ndarray:
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends)


def build_vocabulary(words: list[bytes], counts: list[int], rest: int, hashes: np.ndarray | None = None) -> Vocabulary:
    """Codes of the words and of the escape, which stands for ``rest`` tokens and one more. Of long words the beginnings will do, with ``hashes`` of the whole.

    Words in alphabetical order are halved by weight again and again, so codes are about as long as Huffman's and words of
    like spelling, and so of one language, lie under one node, where contexts can tell them from the rest. Nodes are numbered
    by subtrees of four levels, sixteen numbers each, so that the bits of a token share few lines of the tables.
    """
    if hashes is None:
        hashes = _hash_of(words) if words else np.empty(0, np.uint64)
    order = sorted(range(len(words)), key=lambda i: (words[i], hashes[i]))
    symbol = np.array([0, *(i + 1 for i in order)])
    ends = np.concatenate([[0.0], np.cumsum([rest + 1.0, *(counts[i] for i in order)])])
    n = len(symbol)
    logit, number, paths, node, subtrees = np.zeros(n, np.float32), np.zeros(n, np.uint32), [((), ())] * n, 0, 0
    open_: list[tuple[int, int, int, tuple, tuple]] = [(0, n, 0, (), ())]
    while open_:
        a, b, place, path, turns = open_.pop()
        if b - a == 1:
            paths[symbol[a]] = (path, turns)
            continue
        if len(path) % 4 == 0:
            place, subtrees = subtrees * 16 + 1, subtrees + 1
        half = (ends[a] + ends[b]) / 2
        m = int(np.searchsorted(ends, half))
        m = min(max(m - (half - ends[m - 1] < ends[m] - half), a + 1), b - 1)
        logit[node], number[node] = np.log((ends[b] - ends[m]) / (ends[m] - ends[a])), place
        for turn, (c, d) in enumerate(((a, m), (m, b))):
            open_.append((c, d, (place & ~15) + ((place & 15) * 2 + turn) % 16, (*path, node), (*turns, turn)))
        node += 1
    starts = np.concatenate([[0], np.cumsum([len(p) for p, _ in paths])])
    nodes = np.fromiter((x for p, _ in paths for x in p), np.int32, int(starts[-1]))
    bits = np.fromiter((x for _, t in paths for x in t), np.uint8, int(starts[-1]))
    size = 1 << max(4, (4 * n).bit_length())
    keys, symbols, longest = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
    for s, h in enumerate(hashes.tolist(), 1):
        at, steps = h & (size - 1), 0
        while symbols[at]:
            at, steps = (at + 1) & (size - 1), steps + 1
        keys[at], symbols[at], longest = h, s, max(longest, steps)
    end = words.index(_END) + 1 if _END in words else 0
    return Vocabulary(keys, symbols, longest, np.array([0, *counts], np.int64), end, starts.astype(np.int64), number[nodes], bits, logit[nodes])


@dataclass
class _Tokens:
    symbol: np.ndarray
    suffix: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, and one more


def _tokens(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> _Tokens:
    data = lower_bytes(data)
    starts, ends, first = find_words(data, offsets)
    texts = len(offsets) - 1
    hashes = word_hashes(data, starts, ends)
    place = np.arange(len(starts)) + np.repeat(np.arange(texts), np.diff(first))
    n = len(starts) + texts
    symbol = np.full(n, vocabulary.end, np.int64)
    suffix, own = np.zeros(n, np.uint32), np.zeros(n, np.uint64)
    symbol[place] = vocabulary.find(hashes)
    if len(starts):
        last, before = data[ends - 1].astype(np.uint32), data[np.maximum(ends - 2, starts)].astype(np.uint32)
        suffix[place] = last << np.uint32(8) | before
    own[:] = _hash_of([_END])[0]
    own[place] = hashes
    return _Tokens(symbol, suffix, own, first + np.arange(texts + 1))


def _contexts(t: _Tokens) -> list[np.ndarray]:
    """32-bit contexts of every token: the class of the word before, of the two before, of the second before.

    A frequent word is a class of its own; the others are classed by their last two bytes, which tell the language.
    """
    n = len(t.symbol)
    by_end = (t.suffix * np.uint32(0x9E3779B1) >> np.uint32(23)).astype(np.int64) + OWN_CLASS + 1
    of = np.where((t.symbol > 0) & (t.symbol <= OWN_CLASS), t.symbol, by_end).astype(np.uint32)
    before = np.zeros((2, n), np.uint32)
    for back in (1, 2):
        before[back - 1, back:] = of[:-back]
        for k in range(back):  # none reaches into the text before
            at = t.first[:-1] + k
            before[back - 1, at[at < t.first[1:]]] = 0
    one = before[0] * np.uint32(0x2545F491) + np.uint32(1)
    two = (before[1] * np.uint32(0x6C8E9CF5)) ^ (one * np.uint32(0x9E3779B1))
    return [one, two, before[1] * np.uint32(0x27D4EB2F) + np.uint32(3)]


def _bits(vocabulary: Vocabulary, symbol: np.ndarray, contexts: list[np.ndarray]) -> tuple[Bits, np.ndarray]:
    """The code bits of tokens, and where each token's begin."""
    begin = vocabulary.code_start[symbol]
    lengths = vocabulary.code_start[symbol + 1] - begin
    starts = np.concatenate([[0], np.cumsum(lengths)])
    depth = np.arange(starts[-1], dtype=np.int32)
    depth -= np.repeat(starts[:-1].astype(np.int32), lengths)
    at = np.repeat(begin, lengths)
    at += depth
    np.minimum(depth, DEPTHS - 1, out=depth)
    return Bits(vocabulary.code_node.take(at), vocabulary.code_bit.take(at), depth, [np.repeat(c, lengths) for c in contexts], vocabulary.code_logit.take(at)), starts


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, h, n): each word of some texts, its hash, and how often it occurs in those of them that teach, 0 for one that doesn't."""

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(_hash_of(list(held)).view(np.int64) if held else [], pa.int64()), pa.array(list(held.values()), pa.int64())], ["word", "h", "n"])
        held.clear()
        return made

    held: dict[bytes, int] = {}
    for batch in batches:
        train = batch.column("part").to_numpy() < 2
        if train.any():
            held[_END] = held.get(_END, 0) + int(train.sum())
        for first, last, data, offsets in text_slices(batch.column("text")):
            data = lower_bytes(data)
            starts, ends, at = find_words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            own = np.repeat(train[first:last], np.diff(at))
            _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, own, len(index)).astype(np.int64).tolist()
            raw = data.tobytes()
            for s, e, n in zip(starts[index].tolist(), ends[index].tolist(), counts, strict=True):
                w = raw[s:e]
                held[w] = held.get(w, 0) + n
            if len(held) > 150_000:
                yield rows()
    yield rows()


def _text_streams(shared):
    def streams(batch: pa.RecordBatch) -> Iterator[tuple[int, Bits]]:
        vocabulary: Vocabulary = shared.value
        part = batch.column("part").to_numpy()
        for p in (0, 1):
            for _, _, data, offsets in text_slices(batch.column("text").filter(pa.array(part == p)), COUNTED):
                t = _tokens(vocabulary, data, offsets)
                yield p, _bits(vocabulary, t.symbol, _contexts(t))[0]

    return streams


def _spelled(words: list[bytes]) -> tuple[Bits, np.ndarray]:
    """The bits of words' bytes and of a break after each, and where each word's begin."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer((b" ".join(words) + b" ") if words else b"", np.uint8).astype(np.uint32)
    into = np.arange(len(codes)) - np.repeat(first[:-1], lengths)
    context = np.zeros(len(codes), np.uint32)
    contexts = []
    for back in (1, 2, 3, 4):
        moved = np.zeros(len(codes), np.uint32)
        moved[back:] = codes[:-back]
        context = context | np.where(into >= back, moved, 0).astype(np.uint32) << np.uint32(8 * (back - 1))
        if back > 1:
            contexts.append(np.repeat((context + np.uint32(back)) * np.uint32(0x2545F491), 8))
    shift = np.tile(np.arange(7, -1, -1, dtype=np.uint32), len(codes))
    each = np.repeat(codes, 8)
    node = (each | np.uint32(256)) >> (shift + np.uint32(1))
    depth = (7 - shift).astype(np.int32)
    return Bits(node, (each >> shift & 1).astype(np.uint8), depth, contexts, np.zeros(len(each), np.float32)), first * 8


def _word_streams(batch: pa.RecordBatch) -> Iterator[tuple[int, Bits]]:
    words, part = batch.column("word"), batch.column("part").to_numpy()
    for p in (0, 1):
        some = words.filter(pa.array(part == p)).to_pylist()
        for a in range(0, len(some), 1 << 13):
            yield p, _spelled(some[a : a + (1 << 13)])[0]


def _spell_rows(spelling: Trained):
    """(h, n, spelling, apart): what each word's spelling costs, and, for one that training texts have once, what it costs without its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spelling.mixer()
        for batch in batches:
            words = batch.column("word").to_pylist()
            for a in range(0, len(words), 1 << 13):
                some = words[a : a + (1 << 13)]
                bits, first = _spelled(some)
                spent = _spelling_cost(model, bits, first, 2)
                apart, once = spent.copy(), np.flatnonzero(batch.column("n").slice(a, len(some)).to_numpy() == 1)
                if len(once):
                    bits, first = _spelled([some[i] for i in once.tolist()])
                    part = batch.column("part").slice(a, len(some)).to_numpy()[once]
                    apart[once] = _spelling_cost(model, bits, first, np.repeat(part, np.diff(first)))
                yield pa.RecordBatch.from_arrays([pa.array(_hash_of(some).view(np.int64)), batch.column("n").slice(a, len(some)), pa.array(spent), pa.array(apart)], ["h", "n", "spelling", "apart"])

    return run


def _spelling_cost(model: Mixer, bits: Bits, first: np.ndarray, part: int | np.ndarray) -> np.ndarray:
    x, gate = inputs(model, bits, part)
    return np.add.reduceat(cost(refined_logit(model, mixed_logit(model.weights, x, gate), bits.depth), bits.bit), first[:-1], dtype=np.float64)


def _coded_cost(model: Mixer, vocabulary: Vocabulary, t: _Tokens, part: np.ndarray, rate: float = 0.05) -> np.ndarray:
    """Bits that each token costs, without spellings; ``part`` is that of each text. A text's own weights adapt from run to run."""
    texts = len(t.first) - 1
    if len(vocabulary.counts) == 1:  # nothing but the escape, which has no bits
        return np.zeros(len(t.symbol))
    counts = np.diff(t.first)
    text = np.repeat(np.arange(texts), counts)
    step = (np.arange(len(text)) - t.first[text]) // RUN
    order = np.argsort(step, kind="stable")
    bits, starts = _bits(vocabulary, t.symbol[order], [c[order] for c in _contexts(t)])
    step, text = step[order], text[order]
    runs = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (text[1:] != text[:-1])]))
    step, text, first = step[runs], text[runs], starts[runs]
    sizes = np.diff(first, append=starts[-1])
    x, gate = inputs(model, bits, np.repeat(part.astype(np.uint32)[text], sizes))
    z0 = mixed_logit(model.weights, x, gate)
    own = np.zeros((len(x), texts), np.float32)
    spent = np.empty(len(gate), np.float32)
    cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        who, n, a = text[i:j], sizes[i:j], int(first[i])
        b = a + int(n.sum())
        z, part = z0[a:b], x[:, a:b]
        if i:
            for k in range(len(x)):
                z += np.repeat(own[k, who], n) * part[k]
            np.clip(z, -12, 12, out=z)
        bit = bits.bit[a:b]
        spent[a:b] = cost(refined_logit(model, z, bits.depth[a:b]), bit)
        if j < len(runs):
            error = bit - 1 / (1 + np.exp(-z))
            for k in range(len(x)):
                own[k, who] += rate * np.add.reduceat(error * part[k], first[i:j] - a) / np.sqrt(n)
    each = np.empty(len(order))
    each[order] = np.add.reduceat(spent, starts[:-1], dtype=np.float64)
    return each


def _score_rows(vocabulary_of, trained_mixer: Trained, schema: pa.Schema, blocks: int, frequent: int):
    """Of each text: what needs the vocabulary only, and its other words by their hashes. Besides, its tokens by their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = vocabulary_of.value
        model = trained_mixer.mixer()
        row = TaskContext.get().partitionId() << 33
        logs = np.log10(vocabulary.counts + 1.0)
        held: list[tuple[np.ndarray, ...]] = []

        def deal() -> Iterator[pa.RecordBatch]:
            h, symbol, spent, text, teaches = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            yield from as_rows(dealt(h, symbol, len(vocabulary.counts), spent, text, teaches, blocks), schema)

        for batch in batches:
            part = batch.column("part").to_numpy()
            for first, last, data, offsets in text_slices(batch.column("text"), SLICE):
                t = _tokens(vocabulary, data, offsets)
                size = np.diff(t.first)
                text = np.repeat(np.arange(len(size)), size)
                known = t.symbol > 0
                rare = np.flatnonzero(~known)
                cut = np.searchsorted(rare, t.first)
                n = last - first
                spent = _coded_cost(model, vocabulary, t, part[first:last])
                h, counted = contexts(t.hash, t.first, known & (t.symbol <= frequent))
                at = np.flatnonzero(counted)
                held.append((h[at], t.symbol[at].astype(np.int32), spent[at].astype(np.float32), row + text[at], part[first:last][text[at]] < 2))
                if sum(len(c[0]) for c in held) >= DEAL_TOKENS:
                    yield from deal()
                yield from as_rows(
                    pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + n) % blocks), pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(first, n), batch.column("part").slice(first, n), pa.array(size), pa.array(np.bincount(text, known, n).astype(np.int64)), pa.array(np.bincount(text, logs[t.symbol], n)),
                            pa.array(np.bincount(text, spent, n)), pa.array(offsets[1:] - offsets[:-1]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(t.hash[rare].view(np.int64))),
                        ],
                        ["block", *TEXT_COLUMNS],
                    ),
                    schema,
                )
                row += n
        if held:
            yield from deal()

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", divisor: int = 7, held_out: int = 2, vocabulary: int = VOCABULARY, frequent: int = OWN_CLASS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row.

    Rows with crc32(id as text) mod ``divisor`` = ``held_out`` teach nothing. base_score is the add-one unigram log10
    probability, score the mixed model's. Contexts of three words are counted but for those of the ``frequent`` most frequent
    words alone, in blocks of about ``block_tokens`` tokens.
    """
    spark = docs.sparkSession
    fold = remainder(id_column, divisor)
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.when(fold == held_out, 2).otherwise((fold - held_out + divisor) % divisor % 2).cast("int").alias("part"))
    words = stored(source.select("text", "part").mapInArrow(_word_rows, "word binary, h long, n long").groupBy("word").agg(F.min("h").alias("h"), F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    head = words.where("n > 0").select("n", "h", F.substring("word", 1, 64).alias("start")).orderBy(F.desc("n"), "h").limit(vocabulary).collect()
    coded = sum(r["n"] for r in head)
    built = build_vocabulary([bytes(r["start"]) for r in head], [r["n"] for r in head], total - coded, np.array([r["h"] for r in head], np.int64).view(np.uint64))
    floor = (head[-1]["n"], head[-1]["h"]) if len(head) == vocabulary else None
    del head
    known = spark.sparkContext.broadcast(built)
    training = source.where("part < 2").select("text", "part")
    mixer = trained(training, _text_streams(known), 3, TABLE_BITS)
    others = words.where("n = 0") if floor is None else words.where((F.col("n") < floor[0]) | ((F.col("n") == floor[0]) & (F.col("h") > floor[1])))
    if built.end:
        others = others.where(F.octet_length("word") > 0)
    half = F.pmod(F.xxhash64("word"), F.lit(2)).cast("int").alias("part")
    spelling = trained(words.where("n > 0 and octet_length(word) > 0").select("word", half), _word_streams, 3, SPELL_BITS)
    spelled = others.select("word", "n", half).mapInArrow(_spell_rows(spelling), "h long, n long, spelling double, apart double")
    columns = f"row long, doc_id {docs.schema[id_column].dataType.simpleString()}, part int, n_tokens long, n_known long, logs double, coded double, n_bytes long, rare array<long>"
    dealt_columns = f"block long, least long, keys array<long>, texts array<int>, sizes array<int>, {columns}"
    blocks = max(1, -(-total // block_tokens))
    tokens = source.mapInArrow(_score_rows(known, mixer, to_arrow_schema(spark.createDataFrame([], dealt_columns).schema), blocks, frequent), dealt_columns)
    groups = tasks_for(spark, total, GROUP_TOKENS)
    mixed = tokens.groupBy("block").applyInArrow(mix_blocks(len(built.counts), groups, TEXT_COLUMNS), f"group long, texts array<long>, changes array<float>, {columns}")
    first = stored(mixed.groupBy("group").applyInArrow(sum_groups(TEXT_COLUMNS), f"{columns}, change double"), "scores")
    # Of the escape's words, half the weight goes by how often each was seen (by a training text, elsewhere), half by its spelling.
    weighed = lambda spent, n: -F.log2(0.5 * F.pow(F.lit(2.0), -F.col(spent)) + 0.5 * n / F.lit(float(max(1, total - coded))) + F.lit(1e-300))
    spelled = spelled.select("h", "n", weighed("spelling", F.col("n")).alias("spelling"), weighed("apart", F.greatest(F.col("n") - 1, F.lit(0))).alias("apart"))
    pairs = first.select("row", "part", F.explode("rare").alias("h")).join(spelled, "h").withColumn("spelling", F.when(F.col("part") < 2, F.col("apart")).otherwise(F.col("spelling")))
    more = pairs.select("row", "spelling", (F.col("n") > 0).cast("long").alias("known"), F.log10(F.col("n") + 1).alias("more"))
    rest = more.groupBy("row").agg(F.sum("spelling").alias("spelling"), F.sum("known").alias("known"), F.sum("more").alias("more"))
    joined = first.drop("rare").join(rest, "row", "left")
    bits = F.col("coded") + F.col("change") + F.coalesce("spelling", F.lit(0.0))
    return joined.select(
        "doc_id", (F.col("part") == 2).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (bits * F.lit(-float(np.log10(2)))).alias("score"), (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
