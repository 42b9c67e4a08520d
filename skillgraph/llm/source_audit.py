"""Source divergence audit: how far the words of each source stray from its language's other sources, and on which terms.

Terms are counted once per (lang, source). For every two sources of a language the pairs of counts (c, d) that a term has
in them are tallied, and the divergence is evaluated once per different pair of counts, times the number of terms that
have it. Terms that only one source has give cells (c, 0) and (0, d), those that neither has (0, 0), whose number is what
is left of the language's vocabulary. Terms are dealt out by hash and sources in blocks, so a task holds about
``TERMS`` terms of two blocks and sends on tallies, never pairs of rows.

With p = 1 + floor(10^9 (count + 1) / (N + V)), N the group's counts of kept terms and V their number, the divergence of p
against q is floor((p - q)^2 / q). All of it is whole numbers; counts of any size are taken as decimals.

Defined cases: null text, lang and source are ''; a group without terms counts 0 of each kept term; a language that keeps
none (V = 0) gives pairs of value 0 and no terms; repeated rows are documents each; equal values rank by the item's UTF-8
bytes; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.llm.common import stored

#: Bytes of terms: A-Z as a-z, a-z and all that isn't ASCII as they are, the others part terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Longer texts are split into words in pieces of so many bytes.
PIECE_BYTES = 1 << 22
#: A task sends its counts on when it holds so many.
HELD_TERMS = 300_000
#: Terms of a tile, and sources of a block.
TERMS, BLOCK = 1024, 64
#: Lists of sources up to so many rows are broadcast (about 100 bytes each); longer ones join by shuffle.
BROADCAST_ROWS = 200_000
_TALLY = "lang string, a int, b int, ca long, cb long, n long"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each piece of it."""
    data = data.translate(_TERM_BYTES)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), summed within the task; a null term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            columns = [pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*counts.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64())]
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), *columns], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        size = sum(len(c) for c, _ in held.values())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(counts), set()
            for words in _pieces(text.as_py()):
                counts.update(words)
                own.update(words)
            docs.update(own)
            size += 1 + len(counts) - before
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); a row with a null term for every group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str | Column, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exactly."""
    count = F.col(count) if isinstance(count, str) else count
    above = (count.cast("decimal(20,0)") + F.lit(1)) * F.lit(1_000_000_000)
    return F.call_function("div", above, (F.col(total) + F.col(terms)).cast("decimal(20,0)")) + 1


def _strays(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are about 10^9 at most, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _tallied(key: tuple, table: pa.Table) -> pa.Table:
    """Of a tile's terms: how many have counts ca and cb in sources a and b, for all a < b of its blocks, but for (0, 0)."""
    lang, i, j = (x.as_py() for x in key[:3])
    terms = table.column("term").combine_chunks().dictionary_encode()
    sources, counts = table.column("place").to_numpy(), table.column("n").to_numpy()
    values, ranks = np.unique(np.append(counts, 0), return_inverse=True)  # 0 has rank 0
    there, columns = np.unique(sources, return_inverse=True)
    cells = np.zeros((len(there), len(terms.dictionary)), np.int64)
    cells[columns, terms.indices.to_numpy()] = ranks[:-1]
    every = table.column("sources")[0].as_py()
    places = [x for block in dict.fromkeys((i, j)) for x in range(block * BLOCK, min(every, (block + 1) * BLOCK))]
    at = {x: k for k, x in enumerate(there.tolist())}
    none = np.zeros(cells.shape[1], np.int64)
    out: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    for a in places:
        for b in places:
            if a >= b or a // BLOCK != i or b // BLOCK != j or (a not in at and b not in at):
                continue
            both = (cells[at[a]] if a in at else none) * len(values) + (cells[at[b]] if b in at else none)
            combined, n = np.unique(both[both > 0], return_counts=True)
            out.append((a, b, values[combined // len(values)], values[combined % len(values)], n))
    sizes = [len(x[4]) for x in out]
    joined = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (2, 3, 4)]
    ends = [pa.array(np.repeat(np.array([x[k] for x in out], np.int32), sizes), pa.int32()) for k in (0, 1)]
    return pa.table([pa.repeat(pa.scalar(lang, pa.string()), sum(sizes)), *ends, *[pa.array(x, pa.int64()) for x in joined]], ["lang", "a", "b", "ca", "cb", "n"])


def _pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the divergence of each source from each other."""
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    own = F.floor(F.col("place") / BLOCK).cast("int")
    dealt = kept.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / TERMS)).alias("bucket"), "term", "place", "n", "sources")
    tallies = dealt.groupBy("lang", "i", "j", "bucket").applyInArrow(_tallied, _TALLY).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n"))
    left = groups.select("lang", F.col("place").alias("a"), F.col("total").alias("na"), "terms", F.col("source").alias("sa"))
    right = groups.select("lang", F.col("place").alias("b"), F.col("total").alias("nb"), F.col("source").alias("sb"))
    pairs = stored(left.join(right, "lang").where("a < b"), "source_pairs")  # as many as the result has rows, halved
    few = groups.count() <= BROADCAST_ROWS
    here = tallies.join(F.broadcast(left) if few else left, ["lang", "a"]).join(F.broadcast(right) if few else right, ["lang", "b"])
    p, q = _share("ca", "na", "terms"), _share("cb", "nb", "terms")
    times = F.col("n").cast("decimal(20,0)")
    sums = here.groupBy("lang", "a", "b").agg(F.sum(_strays(p, q) * times).alias("ab"), F.sum(_strays(q, p) * times).alias("ba"), F.sum("n").alias("seen"))
    zero = F.lit(0).cast("decimal(38,0)")
    p, q = _share(F.lit(0), "na", "terms"), _share(F.lit(0), "nb", "terms")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))).cast("decimal(20,0)")
    whole = pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "sa", "sb",
        *[F.when(F.col("terms") > 0, F.coalesce(F.col(name), zero) + _strays(x, y) * rest).otherwise(zero).cast("long").alias(name) for name, x, y in (("ab", p, q), ("ba", q, p))],
    )
    both = F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item"), F.col("ab").alias("value")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item"), F.col("ba").alias("value")))
    return whole.select("lang", F.explode(both).alias("x")).select("lang", "x.*")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the divergence of a source from each other source of its language. Part ``term``: the ``top_terms`` terms
    that a source uses more than its language, and how much each adds to its divergence from it. Terms in fewer than
    ``least_documents`` documents of a language are left out there.
    """
    counts = stored(term_counts(docs, text, lang, source), "term_counts")
    by_term = Window.partitionBy("lang", "term")
    judged = counts.where("term is not null").withColumns({"whole": F.sum("n").over(by_term), "known": F.sum("docs").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = stored(judged.where(F.col("known") >= least_documents).drop("known", "docs"), "kept_terms")
    languages = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    within = Window.partitionBy("lang")
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")], (F.row_number().over(within.orderBy("source")) - 1).alias("place"), F.count("*").over(within).cast("int").alias("sources")), "groups")
    about = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    kept = kept.join(about, ["lang", "source"])
    p, q = _share("n", "total", "terms"), _share("whole", "lang_total", "terms")
    terms = kept.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _strays(p, q).alias("value"))
    pairs = _pair_values(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(best)) for x in (terms, pairs)]
    return ranked[0].where(F.col("rank") <= top_terms).unionByName(ranked[1])
