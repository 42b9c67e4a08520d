"""Fuzzy line dedup by MinHash, in DataFrame operations only.

1. Equal lines are one from here on. A line's shingles are its runs of
   ``shingle`` characters (UTF-16 units: one outside the basic plane counts as two).
   They are cut out of the line's UTF-16 bytes, where each is found at once.
2. Its signature is drawn from all shingles: each hash function is the shingle's
   hash under another XOR mask, and the least value under each makes the signature.
3. ``bands`` bands of ``rows`` values retrieve candidates: of two lines of Jaccard
   similarity 0.8 the eight bands of three miss 3 in 1000, of more similar ones fewer.
   Lines of a small bucket all meet. Lines of a bucket of more than ``small``
   distinct lines first meet two each of its ``leaders``: half of these are lines whose
   buckets hold most lines, so the middle of a group of alike lines, half are any; then all
   pairs of the bucket that no links connect yet meet in tiles, where sizes and
   wide sketches leave out pairs that are certainly too unlike. So the size of a bucket
   changes no component; the comparisons of sketches left grow with the square of a bucket
   whose lines are mostly unlike.
4. Candidates are verified by the Jaccard similarity of all shingles, as 64-bit hashes. First
   sizes and sketches leave out pairs that are certainly too unlike; then the two texts
   meet, and the shingles that both have are counted.
5. Components of the verified links (distributed union-find) keep their first
   line, by document id, the document's keys and line number; the others go.

With shingles of 12 and a similarity of 0.8, a change of one letter inside a line is
found in lines of 119 characters or more, at a line's end in lines of 16 or more.

Defined cases: lines end at newlines; blank lines always stay; a line shorter
than a shingle is its own one shingle; a null text stays null; a document may
lose all lines and then has the empty text; documents are told apart by id and
text: those of one id (null too) with other texts are documents of their own, repeated
rows with the same id and text are one document and treated alike; a null id comes
first; other columns of documents pass through ``dedup_lines`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgraph.llm.common import row_keys, stored
from skillgraph.llm.components import components

#: So many consecutive shingles of a line make one row while signatures are made.
_RUN = 4
#: Longs of a sketch, and of a wide one, which tells more pairs apart that are a little too unlike; powers of two.
_SKETCH, _WIDE = 8, 32


def _masks(n: int) -> list[int]:
    """n fixed 32-bit masks."""
    out = []
    for i in range(1, n + 1):
        x = (i * 0x9E3779B97F4A7C15) & (2**64 - 1)
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        x >>= 32
        out.append(x - 2**32 if x >> 31 else x)
    return out


def _code(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _shingle_at(place: Column, size: int) -> Column:
    """The shingle of ``code`` that begins at a place; the one of a shorter line is the whole."""
    return F.call_function("substring", F.col("code"), 2 * place + 1, F.lit(2 * size))


def _last_place(size: int) -> Column:
    return F.greatest(F.lit(0), (F.octet_length("code") / 2).cast("int") - size)


def _shingled(coded: DataFrame, size: int) -> DataFrame:
    """A row for each shingle of ``code``, with its hash x, instead of ``code``."""
    others = [c for c in coded.columns if c != "code"]
    placed = coded.select(*coded.columns, F.explode(F.sequence(F.lit(0), _last_place(size))).alias("i"))
    return placed.select(*others, F.xxhash64(_shingle_at(F.col("i"), size)).alias("x"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, line_no, line of the lines that aren't blank. ``docs``: doc_id, text."""
    k1, k2 = row_keys("doc_id", "text")
    return docs.where("text is not null").select("doc_id", k1.alias("k1"), k2.alias("k2"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "")


def signatures(lines: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(h, keys) of every distinct line: the hash of the line and one key for each band."""
    runs = lines.select(F.xxhash64("line").alias("h"), _code(F.col("line")).alias("code")).select("h", "code", F.explode(F.sequence(F.lit(0), _last_place(shingle), F.lit(_RUN))).alias("i"))
    # The last run is filled up with the last shingle.
    hashed = runs.select("h", *[F.hash(_shingle_at(F.least(F.col("i") + j, _last_place(shingle)), shingle)).alias(f"x{j}") for j in range(_RUN)])
    least = hashed.groupBy("h").agg(*[F.min(F.least(*[F.col(f"x{j}").bitwiseXOR(F.lit(m)) for j in range(_RUN)])).alias(f"m{i}") for i, m in enumerate(_masks(bands * rows))])
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)])
    return least.select("h", keys.alias("keys"))


def _star_pairs(many: DataFrame, leaders: int, salt: int) -> DataFrame:
    """Pairs (a, b): each line of buckets (key, h, place) with two of its bucket's leaders, in every bucket it is in.

    Leaders are half those of the greatest ``place``, half any; ties and choice are by hashes.
    """
    half = (leaders + 1) // 2
    drawn = [F.xxhash64("h", "key", F.lit(salt * leaders + i)) for i in range(leaders)]
    least = lambda *by: F.min(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(by)], F.col("h").alias("h"))).getField("h")
    middle = F.array_distinct(F.array(*[least(-F.col("place"), r) for r in drawn[:half]]))
    led = many.groupBy("key").agg(middle.alias("middle"), F.array_distinct(F.array(*[least(r) for r in drawn[half:] or drawn])).alias("any"))
    own = [F.get(c, F.pmod(F.xxhash64("key", "h", F.lit(salt)), F.size(c)).cast("int")) for c in ("middle", "any")]
    return many.join(led, "key").select("h", F.explode(F.array(*own)).alias("leader")).where("h <> leader").select(F.least("h", "leader").alias("a"), F.greatest("h", "leader").alias("b"))


def _placed(many: DataFrame) -> DataFrame:
    """``many`` (key, h, n) with place: how many lines are in a line's buckets. The middle of a group of alike lines is in most of their buckets, a line at its edge in few."""
    return many.join(many.groupBy("h").agg(F.sum("n").alias("place")), "h")


def banded(signed: DataFrame) -> DataFrame:
    """key, h, n: the buckets of more than one line, and how many lines each has."""
    each = signed.select("h", F.explode("keys").alias("key"))
    return each.join(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def candidates(members: DataFrame, small: int, leaders: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of lines to be verified at first."""
    few = members.where(F.col("n") <= small).select("key", "h")
    pairs = few.join(few.withColumnRenamed("h", "b"), "key").where("h < b").select(F.col("h").alias("a"), "b")
    return pairs.unionByName(_star_pairs(_placed(members.where(F.col("n") > small)), leaders, 0)).distinct()


def sketches(texts: DataFrame, shingle: int, longs: int = _SKETCH) -> DataFrame:
    """h, size, k0, k1, ...: of each text how many shingles it has, and the parity of their number at each of 64 * ``longs`` places.

    Two texts' parities differ at no more places than there are shingles that only one of the two has.
    """
    # All shingles of a line lie in one partition from here on, so none of the aggregations shuffles.
    each = _shingled(texts.repartition("h").select("h", _code(F.col("line")).alias("code")), shingle).distinct()
    bit, at = F.expr("shiftleft(1L, cast(x & 63 as int))"), F.pmod(F.shiftrightunsigned("x", 6), F.lit(longs))
    slots = each.groupBy("h", at.alias("at")).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("k"))
    return slots.groupBy("h").agg(F.sum("n").alias("size"), *[F.coalesce(F.max(F.when(F.col("at") == i, F.col("k"))), F.lit(0).cast("long")).alias(f"k{i}") for i in range(longs)])


def _can_be_like(least: float, longs: int = _SKETCH) -> Column:
    """Whether two sketches (one's columns end in _) leave a similarity of ``least`` open."""
    differ = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"k{i}_"))) for i in range(longs)), F.lit(0))
    near = F.least("size", "size_") >= least * F.greatest("size", "size_")
    return near & (differ <= (1 - least) / (1 + least) * (F.col("size") + F.col("size_")) + 1e-6)


def _texts(lines: DataFrame, needed: DataFrame, broadcast_rows: int) -> DataFrame:
    """h, line of the lines whose hashes are needed."""
    wanted = F.broadcast(needed) if needed.count() <= broadcast_rows else needed  # 16 bytes a row, 32 MB
    return stored(lines.select(F.xxhash64("line").alias("h"), "line").join(wanted, "h", "left_semi").groupBy("h").agg(F.max("line").alias("line")), "texts")


def like_by_sketch(pairs: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """a, b, sizes (of both together) of the pairs whose sketches leave a similarity of ``least`` open."""
    other = sketched.select(*[F.col(c).alias(f"{c}_") for c in sketched.columns])
    like = pairs.join(sketched, pairs["a"] == sketched["h"]).join(other, pairs["b"] == other["h_"]).where(_can_be_like(least))
    return like.select("a", "b", (F.col("size") + F.col("size_")).alias("sizes"))


def verified(like: DataFrame, texts: DataFrame, shingle: int, least: float, task_shingles: int = 2_000_000) -> DataFrame:
    """The pairs (a, b) of ``like`` (a, b, sizes) whose texts' shingles have a Jaccard similarity of at least ``least``."""
    open_ = stored(like.select(F.monotonically_increasing_id().alias("pair"), "a", "b", "sizes"), "open")
    met = open_.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    sides = F.array(*[F.struct(F.lit(n).alias("side"), _code(F.col(c)).alias("code")) for n, c in ((1, "x"), (2, "y"))])
    # All shingles of a pair lie in one partition, so neither aggregation shuffles; a task holds about ``task_shingles``.
    tasks = 1 + (open_.agg(F.sum("sizes")).first()[0] or 0) // task_shingles
    coded = met.select("pair", "x", "y").repartition(tasks, "pair").select("pair", F.explode(sides).alias("s")).select("pair", "s.side", "s.code")
    shared = _shingled(coded, shingle).groupBy("pair", "x").agg(F.bit_or("side").alias("sides")).groupBy("pair").agg(F.count_if(F.col("sides") == 3).alias("shared"))
    return open_.join(shared, "pair").where(F.col("shared") >= least * (F.col("sizes") - F.col("shared"))).select("a", "b")


def _apart(many: DataFrame, found: DataFrame) -> DataFrame:
    """key, n, n_rest, h, root, rest of the buckets whose lines are not all of one component yet; rest: outside the bucket's largest one."""
    placed = stored(many.join(components(found).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "root")).getField("root").alias("main"), F.count("*").alias("parts"), (F.sum("c") - F.max("c")).alias("n_rest")).where("parts > 1")
    return stored(placed.join(main, "key").select("key", "n", "n_rest", "h", "root", (F.col("root") != F.col("main")).alias("rest")), "apart")


def remaining(apart: DataFrame, sketched: DataFrame, least: float, tile: int) -> DataFrame:
    """Distinct a, b, sizes, a < b, of lines of one bucket and different components that can be as similar as ``least``. ``sketched``: wide sketches.

    Every line outside a bucket's largest component meets every line of the bucket, both in tiles of about ``tile`` lines, so
    no task holds more than two tiles of a bucket; sizes and sketches leave out only pairs that are certainly less similar.
    """
    names = ["h", "root", "size", *[f"k{i}" for i in range(_WIDE)]]
    cut = lambda c: F.ceil(F.col(c) / tile).cast("int")
    own = lambda salt, c: F.pmod(F.xxhash64("h", F.lit(salt)), cut(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), cut(c) - 1))
    full = apart.join(sketched, "h")
    left = full.where("rest").select("key", own(-2, "n_rest").alias("i"), each("n").alias("j"), *[F.col(c).alias(f"{c}_") for c in names])
    right = full.select("key", each("n_rest").alias("i"), own(-1, "n").alias("j"), "rest", *names)
    met = left.join(right, ["key", "i", "j"]).where((F.col("root") != F.col("root_")) & (~F.col("rest") | (F.col("h_") < F.col("h"))) & _can_be_like(least, _WIDE))
    return met.select(F.least("h", "h_").alias("a"), F.greatest("h", "h_").alias("b"), (F.col("size") + F.col("size_")).alias("sizes")).distinct()


def links(lines: DataFrame, shingle: int = 12, bands: int = 8, rows: int = 3, least: float = 0.8, small: int = 24, leaders: int = 8, broadcast_rows: int = 2_000_000, tile: int = 1024, direct: int = 200_000) -> DataFrame:
    """(a, b): hashes of different lines whose shingles' Jaccard similarity is at least ``least``.

    All that share a bucket of up to ``small`` lines; of larger buckets, as many as make the same components as all.
    """
    members = stored(banded(stored(signatures(lines, shingle, bands, rows), "signatures")), "members")
    pairs = stored(candidates(members, small, leaders), "pairs")
    # Every line of a bucket is in one of these pairs at least, so all later ones find their texts and sketches here.
    texts = _texts(lines, stored(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "needed"), broadcast_rows)
    sketched = stored(sketches(texts, shingle), "sketches")
    found = stored(verified(like_by_sketch(pairs, sketched, least), texts, shingle, least), "found")
    many = members.where(F.col("n") > small)
    if many.isEmpty():
        return found
    # Other leaders as long as they spare much of what is left; then all that is left.
    left = None
    for salt in range(1, 16):
        apart = _apart(many, found)
        work = apart.where("rest").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not work:
            return found
        if work <= direct or (left is not None and work > 0.7 * left):
            break
        left = work
        roots = apart.select("h", "root").distinct()
        stars = _star_pairs(_placed(apart.select("key", "h", "n")), leaders, salt).distinct()
        stars = stars.join(roots.select(F.col("h").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("h").alias("b"), F.col("root").alias("y")), "b").where("x <> y").select("a", "b")
        found = stored(found.unionByName(verified(like_by_sketch(stars, sketched, least), texts, shingle, least)), "found")
    else:
        apart = _apart(many, found)
    wide = stored(sketches(texts.join(apart.select("h").distinct(), "h", "left_semi"), shingle, _WIDE), "sketches")
    return found.unionByName(verified(remaining(apart, wide, least, tile), texts, shingle, least))


def removed_lines(docs: DataFrame, **settings) -> DataFrame:
    """(k1, k2, gone, n_gone): which lines of each document go: an x for each that does, a dot for others. ``docs``: doc_id, text."""
    lines, keys = _lines(docs), ["k1", "k2"]
    placed = stored(lines.select("doc_id", *keys, "line_no", F.xxhash64("line").alias("h")), "placed")
    roots = components(links(lines, **settings))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", *keys, "line_no")
    # Equal lines: their first place. It is taken as the least of each document first, so hot lines are summed early.
    firsts = placed.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    firsts = firsts.join(roots.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "h"))
    kept = firsts.groupBy("root").agg(F.min("first").alias("kept"))
    kept = stored(firsts.join(kept, "root").select("h", "n", F.struct("kept.k1", "kept.k2", "kept.line_no").alias("kept")), "kept")
    # Lines that make up over one in 10,000 of all are at most that many.
    often = kept.where(F.col("n") > placed.count() / 10_000).drop("n")
    seldom = kept.where(F.col("n") <= placed.count() / 10_000).drop("n")
    met = placed.join(F.broadcast(often), "h").unionByName(placed.join(F.broadcast(often), "h", "left_anti").join(seldom, "h"))
    gone = met.where((F.col("k1") != F.col("kept.k1")) | (F.col("k2") != F.col("kept.k2")) | (F.col("line_no") != F.col("kept.line_no")))
    listed = stored(gone.groupBy(*keys).agg(F.array_sort(F.collect_set("line_no")).alias("at")), "gone")
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("at", i - 1))
    marks = F.array_join(F.transform("at", lambda n, i: F.concat(F.repeat(F.lit("."), n - before(i) - 1), F.lit("x"))), "")
    return listed.select(*keys, marks.cast("binary").alias("gone"), F.size("at").cast("long").alias("n_gone"))


def cleaned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", broadcast_bytes: int = 32_000_000, **settings) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., with the removed lines taken out of the text, and n_lines and n_removed."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no name of the caller's meets one of ours
    at_id, at_text = (inner[docs.columns.index(c)] for c in (id_column, text))
    own = docs.toDF(*inner)
    gone = stored(removed_lines(own.select(F.col(at_id).alias("doc_id"), F.col(at_text).alias("text")), **settings), "marks")
    if gone.agg(F.coalesce(F.sum(F.octet_length("gone") + 40), F.lit(0))).first()[0] <= broadcast_bytes:
        gone = F.broadcast(gone)
    k1, k2 = row_keys(at_id, at_text)
    split = F.split(F.col(at_text), "\n")
    kept = F.array_join(F.filter(split, lambda line, i: F.call_function("substring", F.col("gone"), i + 1, F.lit(1)) != F.lit(b"x")), "\n")
    joined = own.withColumns({"k1": k1, "k2": k2}).join(gone, ["k1", "k2"], "left")
    counted = joined.withColumns({"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "n_removed": F.coalesce("n_gone", F.lit(0)).cast("long")})
    return counted.withColumn(at_text, F.when(F.col("gone").isNull(), F.col(at_text)).otherwise(kept)).select(*inner, "n_lines", "n_removed")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", broadcast_bytes: int = 32_000_000, **settings) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and two more columns: _n_lines_ and _n_removed_. Columns of ``docs`` that are called so give way; any other name is left alone."""
    found = cleaned(docs, id_column, text, broadcast_bytes, **settings)
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in ("_n_lines_", "_n_removed_")]
    return found.select(*[c for c, _ in kept], "n_lines", "n_removed").toDF(*[c for _, c in kept], "_n_lines_", "_n_removed_")
