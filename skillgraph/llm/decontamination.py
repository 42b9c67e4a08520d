"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

1. Every benchmark item is cut into windows of ``window`` consecutive words (an
   item of fewer words is one window); equal windows are one.
2. Words are ordered by rarity: how often each benchmark word occurs in the
   corpus. A window's prefix is its rarest word, with its place in the window:
   a text that holds the window holds that word.
3. Corpus words join the prefixes. Each hit fixes where the window would lie;
   it must lie within the text (length and position bounds), and its words must be
   the window's, one for one (exact containment).
4. Overlapping occurrences merge, so each hit word counts once.

Prefixes are broadcast only up to ``broadcast_windows`` windows, and which items hold
which windows up to four times as many rows; above that they join by shuffle, and texts
are met again by their keys for the last step.

Defined cases: null texts and items have no words; items without words and
items with a null id match nothing; repeated items are one; repeated rows of
documents each get a row; rows are told apart by id and text, so rows of one id
(null too) are judged each by its own text; an empty benchmark leaves every
document clean; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.llm.common import ascii_lower, row_keys, stored

_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words, perhaps with an empty string first and last (cutting those off would copy the array)."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS)


def _count(split: Column) -> Column:
    first = (F.element_at(split, 1) == "").cast("long")
    last = ((F.size(split) > 1) & (F.element_at(split, -1) == "")).cast("long")
    return F.size(split) - first - last


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(gram, g1, g2, item): the words of each distinct window, its two hashes, and an item that holds it, as a string."""
    cut = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.filter(words(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    grams = cut.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice("w", i, window))).alias("gram"))
    return grams.select("gram", F.xxhash64("gram").alias("g1"), F.xxhash64(F.size("gram"), F.lit(7), "gram").alias("g2"), "item").distinct()


def prefixes(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(word, place, gram, g1, g2): each window by its rarest word in ``docs`` (w)."""
    vocabulary = windows.select(F.explode("gram").alias("word")).distinct()
    seen = docs.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").count()
    places = windows.select("gram", "g1", "g2", F.posexplode("gram").alias("place", "word")).join(seen, "word", "left")
    rarity = F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("place").alias("place"), F.col("word").alias("word"))
    best = places.groupBy("g1", "g2").agg(F.min(rarity).alias("best"), F.first("gram").alias("gram"))
    return best.where("best.n > 0").select("best.word", "best.place", "gram", "g1", "g2")


def hits(docs: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """(k1, k2, start, stop, g1, g2) of every occurrence of a window; start and stop count entries of w."""
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.size("gram") <= F.size("w"))
    same = F.slice("w", start + 1, F.size("gram")) == F.col("gram")
    if small:
        met = docs.select("k1", "k2", "w", F.posexplode("w").alias("at", "word")).join(F.broadcast(found), "word")
    else:
        near = docs.select("k1", "k2", F.posexplode("w").alias("at", "word")).join(found, "word").select("k1", "k2", "at", "place", "gram", "g1", "g2").where("at >= place")
        met = near.join(docs.select("k1", "k2", "w"), ["k1", "k2"])
    return met.where(fits).where(same).select("k1", "k2", start.alias("start"), (start + F.size("gram")).alias("stop"), "g1", "g2").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with an occurring window, sorted as strings) of each row, and the row's keys k1, k2."""
    keys = ["k1", "k2"]
    k1, k2 = row_keys(id_column, text)
    source = docs.select(F.col(id_column).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), words(F.col(text)).alias("w"))
    holders = stored(benchmark_windows(benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")), window), "windows")
    windows = holders.select("gram", "g1", "g2").distinct()
    small = windows.count() <= broadcast_windows  # at some 200 bytes a window, 40 MB
    found = stored(prefixes(source, windows, small), "prefixes")
    met = stored(hits(source, found, small), "hits")
    before = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
    n_hit = met.select(*keys, "start", "stop").distinct().withColumn("covered", covered).groupBy(*keys).agg(F.sum("covered").alias("n_hit"))
    of_window = holders.select("g1", "g2", "item")
    if of_window.count() <= 4 * broadcast_windows:  # at some 40 bytes, 32 MB
        of_window = F.broadcast(of_window)
    items = met.select(*keys, "g1", "g2").distinct().join(of_window, ["g1", "g2"]).groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))
    counts = source.select("doc_id", *keys, _count(F.col("w")).cast("long").alias("n_words"))
    judged = n_hit.join(items, keys)
    return counts.join(judged, keys, "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *keys)
