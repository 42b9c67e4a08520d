"""Projection of a bipartite graph on its entities, guarded against features with too many pairs, and closest entities."""

from __future__ import annotations

from decimal import Decimal
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgraph.functions import meeting
from skillgraph.storage import stored, tasks_for

#: A feature's entities are listed in parts of about this many.
LISTED = 1_000
#: Pairs that one task adds up, by a count made first (about 100 bytes each).
PAIRS_AT_ONCE = 2_000_000
#: Pairs of entities for each pair of an entity's features, from which the latter are looked at instead; pairs sharing two features that are broadcast at most.
FEWER, TWICE = 4, 3_000_000


def guarded(edges: DataFrame, entity: str = "entity", feature: str = "feature", first_seen: str | None = None, max_degree: int | None = 2_000, max_pairs: int = 1_500_000, max_total: int = 25_000_000) -> DataFrame:
    """Every feature with its degree, pairs and verdict: used, single, degree, pairs or total.

    The limit on all pairs is first-fit in the order of ``first_seen`` (or the feature): a feature that doesn't fit uses
    nothing up. Spark takes whole runs of leading features by running sums; only when those that can still fit are few
    are they folded one by one. Without limits (``max_degree`` None, the others 0) every feature with a pair is used.
    """
    order = first_seen or feature
    counted = edges.groupBy(feature).agg(F.count_distinct(entity).alias("degree"), F.min(order).alias("first_seen")).withColumn("pairs", F.expr("degree * (degree - 1) div 2"))
    crowded = F.lit(False) if max_degree is None else F.col("degree") > max_degree
    small = (F.col("pairs") > max_pairs) if max_pairs > 0 else F.lit(False)
    verdict = F.when(F.col("degree") < 2, "single").when(crowded, "degree").when(small, "pairs").otherwise("used")
    judged = counted.withColumn("verdict", verdict)
    if max_total <= 0 or (judged.where("verdict = 'used'").agg(F.sum("pairs")).first()[0] or 0) <= max_total:
        return judged
    taken = _first_fit(judged.where("verdict = 'used'").select("first_seen", F.col(feature).alias("f"), "pairs"), max_total)
    marked = judged.join(taken.select(F.col("f").alias(feature), F.lit(True).alias("_in")), feature, "left")
    return marked.withColumn("verdict", F.when((F.col("verdict") == "used") & F.col("_in").isNull(), "total").otherwise(F.col("verdict"))).drop("_in")


def _first_fit(features: DataFrame, room: int, few: int = 100_000) -> DataFrame:
    """(f) of the features (first_seen, f, pairs) that fit one after another into ``room`` pairs; one that doesn't uses nothing up.

    A run of leading features whose running sum fits is taken whole; after it only smaller ones can fit, and so on. Running
    sums are made within sorted partitions, whose totals are a row each.
    """
    spark = features.sparkSession
    left, runs = features.where(F.col("pairs") <= room), []
    while left.count() > few:
        placed = stored(left.orderBy("first_seen", "f").withColumn("_part_", F.spark_partition_id()), "fit")
        starts, begin = [(-1, 0)], 0
        for r in placed.groupBy("_part_").agg(F.sum("pairs").alias("n")).orderBy("_part_").collect():  # a row for each partition
            starts.append((r["_part_"], begin))
            begin += r["n"]
        offsets = F.broadcast(spark.createDataFrame(starts, "_part_ int, _start_ long"))
        order = Window.partitionBy("_part_").orderBy("first_seen", "f")
        summed = stored(placed.withColumn("_sum_", F.sum("pairs").over(order)).join(offsets, "_part_").withColumn("_sum_", F.col("_sum_") + F.col("_start_")), "fit")
        fits = F.col("_sum_") <= room
        runs.append(summed.where(fits).select("f"))
        room -= summed.where(fits).agg(F.coalesce(F.max("_sum_"), F.lit(0))).first()[0]
        left = summed.where(~fits & (F.col("pairs") <= room)).select("first_seen", "f", "pairs")
    last = []
    for r in left.orderBy("first_seen", "f").collect():  # ``few`` rows at most
        if r["pairs"] <= room:
            room -= r["pairs"]
            last.append((r["f"],))
    taken = spark.createDataFrame(last, features.select("f").schema)
    for run in runs:
        taken = taken.unionByName(run)
    return taken


def _links(edges: DataFrame, entity: str, feature: str, weight: str, used: DataFrame | None) -> DataFrame:
    """(a, f, w) of the edges that may take part, stored, since they are read several times."""
    own = edges.select(F.col(entity).alias("a"), F.col(feature).alias("f"), F.col(weight).alias("w")).where("a is not null and f is not null")
    if used is not None:
        own = own.join(used.select(F.col(feature).alias("f")), "f", "left_semi")
    return stored(own, "edges")


def pair_scores(edges: DataFrame, entity: str = "entity", feature: str = "feature", weight: str = "weight", used: DataFrame | None = None) -> DataFrame:
    """(a, b, shared_count, weighted_score) of entities that share features, a < b; the score sums the lesser weights.

    Weights are decimals, so sums don't depend on their order. ``used``: the features that may take part.

    Where entities have few features, the few pairs that share several of them are found first, and added up; all others meet
    once, where their feature's entities are listed, and cross no network. Otherwise every edge takes those of its feature's
    entities that come after its own to that, in one shuffle, to as many tasks as the number of pairs wants.
    """
    own = _links(edges, entity, feature, weight, used)
    name, kind = own.schema["a"].dataType, T.DecimalType(min(38, own.schema["w"].dataType.precision + 10), own.schema["w"].dataType.scale) if isinstance(own.schema["w"].dataType, T.DecimalType) else None
    own, places, whole = _compact(own)
    met, pairs, most = _met(own, later=True)
    twice = _twice(own, pairs, most)
    if twice is not None:
        summed = _once(met, twice)
    else:
        met = met.repartition(tasks_for(own.sparkSession, pairs, PAIRS_AT_ONCE), "a")
        if whole and isinstance(name, T.LongType):
            summed = met.withColumn("many", F.lit(False)).mapInArrow(meeting.added, "a long, b long, shared_count long, weighted_score long")
        else:
            each = met.select("*", F.posexplode("bs").alias("_i", "b")).where("a <> b")
            summed = each.groupBy("a", "b").agg(F.count("*").alias("shared_count"), F.sum(F.least("w", F.get("vs", F.col("_i")))).alias("weighted_score"))
    score = F.col("weighted_score")
    if isinstance(summed.schema["weighted_score"].dataType, T.LongType) and kind is not None:
        score = (score.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))).cast(kind)
    return summed.select(F.col("a").cast(name).alias("a"), F.col("b").cast(name).alias("b"), "shared_count", score.alias("weighted_score"))


def _twice(edges: DataFrame, pairs: int, most: int) -> DataFrame | None:
    """(a, b, f, v) of the pairs that share two features or more, a < b, a row for each of these; v is the lesser weight.

    Such a pair meets in each two of its features, so these are looked at instead of its entities' lists: None where they would
    not be far fewer than all pairs, where very many pairs are found or a feature has very many entities, or where an edge comes twice.
    """
    spark = edges.sparkSession
    size = F.expr("n * (n - 1) div 2")
    both = edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.sum(size)).first()[0] or 0
    if FEWER * both > pairs or most > 100 * LISTED:
        return None
    each = stored(edges.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("l")).where(F.size("l") > 1), "features")
    if not each.where(F.size(F.array_distinct("l.f")) < F.size("l")).isEmpty():
        return None
    two = each.select("a", "l", F.posexplode("l").alias("_i", "x")).select("a", "x", F.explode(F.slice("l", F.col("_i") + 2, F.size("l"))).alias("y"))
    two = two.withColumn("h", F.xxhash64("x.f", "y.f").bitwiseAND(F.lit((1 << 40) - 1)))  # the fewer bytes cross the network; others of the same hash go below
    again = stored(two.select("h").repartition(tasks_for(spark, both, PAIRS_AT_ONCE), "h").groupBy("h").count().where("count > 1").select("h"), "again")
    if again.count() > TWICE:
        return None
    dealt = two.join(F.broadcast(again), "h", "left_semi").select("a", F.col("x.f").alias("f"), F.col("y.f").alias("g"), F.col("x.w").alias("wf"), F.col("y.w").alias("wg"))
    groups = stored(dealt.groupBy("f", "g").agg(F.collect_list(F.struct("a", "wf", "wg")).alias("l")).where("size(l) > 1"), "twice")
    if (groups.withColumn("n", F.size("l").cast("long")).agg(F.sum(size)).first()[0] or 0) > min(TWICE, pairs // (4 * FEWER)):
        return None
    ways = groups.select("f", "g", "l", F.explode("l").alias("x")).select("f", "g", "x", F.explode("l").alias("y")).where("x.a < y.a")
    of = lambda feature, w: F.struct(F.col(feature).alias("f"), F.least(f"x.{w}", f"y.{w}").alias("v"))
    rows = ways.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.explode(F.array(of("f", "wf"), of("g", "wg"))).alias("s")).select("a", "b", "s.*")
    return stored(rows.dropDuplicates(["a", "b", "f"]), "twice")


def _once(met: DataFrame, twice: DataFrame) -> DataFrame:
    """(a, b, shared_count, weighted_score): pairs of ``twice`` added up, all others as they meet, which they do once."""
    many = twice.groupBy("a", "b").agg(F.count("*").alias("shared_count"), F.sum("v").alias("weighted_score"))
    each = met.select("*", F.posexplode("bs").alias("_i", "b")).select("a", "b", F.lit(1).cast("long").alias("shared_count"), F.least("w", F.get("vs", F.col("_i"))).cast(many.schema["weighted_score"].dataType).alias("weighted_score"))
    if twice.isEmpty():
        return each
    return each.join(F.broadcast(twice.select("a", "b").distinct()), ["a", "b"], "left_anti").unionByName(many)  # ``TWICE`` pairs at most


def projection_stats(judged: DataFrame) -> DataFrame:
    """One row: features, pairs and edges, and how many of them each limit left out."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    pairs = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("pairs"))), F.lit(0))
    edges = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("degree"))), F.lit(0))
    return judged.agg(
        F.count("*").alias("features"), count("used").alias("features_used"), count("single").alias("features_single"), count("degree").alias("skipped_by_degree"), count("pairs").alias("skipped_by_pairs"), count("total").alias("skipped_by_total"),
        pairs("used").alias("pairs_used"), pairs("degree").alias("pairs_skipped_by_degree"), pairs("pairs").alias("pairs_skipped_by_pairs"), pairs("total").alias("pairs_skipped_by_total"),
        edges("degree").alias("edges_skipped_by_degree"), edges("pairs").alias("edges_skipped_by_pairs"), edges("total").alias("edges_skipped_by_total"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.max("pairs"), F.lit(0)).alias("max_pairs"),
    )


def closest(pairs: DataFrame, score: str, k: int = 20, threshold: float = 0.0, method: str | None = None) -> DataFrame:
    """(entity, neighbor, similarity_score, rank[, method]): the ``k`` best neighbours of each entity (all if k <= 0), ties by neighbour."""
    fit = pairs.where(F.col(score) >= F.lit(threshold))
    # Both directions of a pair from one row, so that the pairs are made once.
    way = lambda x, y: F.struct(F.col(x).alias("entity"), F.col(y).alias("neighbor"), F.col(score).alias("s"))
    both = fit.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_p")).select("_p.*")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("s"), "neighbor")))
    if k > 0:
        ranked = ranked.where(F.col("rank") <= k)
    out = ranked.select("entity", "neighbor", F.round(F.col("s").cast("double"), 6).alias("similarity_score"), "rank")
    return out.withColumn("method", F.lit(method)) if method else out


def similarity(pairs: DataFrame, method: str = "both", k: int = 20, threshold: float = 0.0) -> DataFrame:
    """Closest entities by shared features (unweighted), by shared weight (weighted), or both."""
    scores = {"unweighted": "shared_count", "weighted": "weighted_score"}
    if method != "both" and method not in scores:
        raise ValueError(f"unknown method: {method}")
    frames = [closest(pairs, s, k, threshold, m) for m, s in scores.items() if method in (m, "both")]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def _profiles(edges: DataFrame) -> DataFrame:
    """(a, rep, n) of every entity of the edges (a, f, w): the least entity with the same features and weights, and how many there are of these.

    Sets of edges are told apart by their number and the sums of 128 bits of hash, in four parts, so that no sum overflows.
    """
    marks = [part(F.xxhash64(*c)) for c in (("f", "w"), (F.lit(1), "w", "f")) for part in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit((1 << 32) - 1)))]
    names = ["_n", *[f"_x{i}" for i in range(len(marks))]]
    own = edges.groupBy("a").agg(F.count("*").alias("_n"), *[F.sum(m).alias(name) for m, name in zip(marks, names[1:], strict=True)])
    same = own.groupBy(*names).agg(F.min("a").alias("rep"), F.count("*").alias("n"))
    return own.join(same, names).select("a", "rep", "n")


def _narrowest(least: int, most: int) -> str:
    """The type of whole numbers that holds a range with the fewest bytes."""
    return next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << bits) <= least and most < 1 << bits)


def _compact(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """Edges (a, f, w) with numbered entities, and decimal weights as whole numbers, in the fewest bytes that hold them; how many of a weight's places were kept; whether all weights are such whole numbers, none NULL.

    Whole numbers also add up faster. Weights whose sums might overflow stay decimals.
    """
    kinds = {c: edges.schema[c].dataType for c in ("a", "w")}
    whole, asked = isinstance(kinds["a"], T.LongType), [F.approx_count_distinct("f").alias("features")]
    if whole:
        asked += [F.min("a").alias("low"), F.max("a").alias("high")]
    places = kinds["w"].scale if isinstance(kinds["w"], T.DecimalType) else None
    if places is not None:
        asked += [F.max(F.abs("w")).alias("most"), F.count_if(F.col("w").isNull()).alias("none")]
        short = kinds["w"].precision <= 18  # then a long holds them in units of their last place
        cut = lambda i: F.col("_u") % 10 ** (places - i) != 0 if short else F.round("w", i) != F.col("w")
        asked += [F.count_if(cut(i)).alias(f"p{i}") for i in range(places)]
    found = (edges.withColumn("_u", (F.col("w") * F.lit(10**places)).cast("long")) if places and short else edges).agg(*asked).first()
    if whole and found["low"] is not None:
        edges = edges.withColumn("a", F.col("a").cast(_narrowest(found["low"], found["high"])))
    if places is None or found["most"] is None:
        return edges, 0, False
    places = next((i for i in range(places) if not found[f"p{i}"]), places)
    most = int(found["most"] * 10**places)
    if 2 * found["features"] * most >= 1 << 62:
        return edges, 0, False
    return edges.withColumn("w", (F.col("w") * F.lit(10**places)).cast(_narrowest(-most, most))), places, not found["none"]


def _parts(edges: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges with part, lists (f, part, bs, ws) of the entities of ``listed``, number of pairs that they make). An edge stands once for each part of its feature's list."""
    sizes = listed.groupBy("f").agg(F.count("*").alias("n"))
    pairs = edges.groupBy("f").agg(F.count("*").alias("m")).join(sizes, "f").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    long = stored(sizes.where(F.col("n") > LISTED).select("f", F.ceil(F.col("n") / LISTED).cast("int").alias("parts")), "long")
    cut = lambda df: df.join(F.broadcast(long), "f", "left") if not long.isEmpty() else df.withColumn("parts", F.lit(1))
    parts = F.coalesce("parts", F.lit(1))
    lists = cut(listed).withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).groupBy("f", "part").agg(F.collect_list(F.struct("b", "v")).alias("l")).select("f", "part", F.col("l.b").alias("bs"), F.col("l.v").alias("vs"))
    return cut(edges).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"), lists, pairs


def _met(own: DataFrame, later: bool = False) -> tuple[DataFrame, int, int]:
    """(rows (a, w, bs, vs): an edge and entities of its feature with their weights, number of pairs that these make, most entities of a feature).

    ``later``: only entities greater than a. Lists are cut into their edges' rows where they are made; only those of features with
    more than ``LISTED`` entities are made in parts and meet their edges in a join.
    """
    spark = own.sparkSession
    sizes = stored(own.groupBy("f").agg(F.count("*").alias("n")), "sizes")
    pairs, most = (x or 0 for x in sizes.agg(F.sum(F.col("n") * F.col("n")), F.max("n")).first())
    pairs = (pairs - own.count()) // 2 if later else pairs
    listed = lambda df: df.select(F.col("a").alias("b"), "f", F.col("w").alias("v"))
    short, long = own, None
    if most > LISTED:
        known = F.broadcast(sizes.where(F.col("n") > LISTED).select("f"))
        short, long = own.join(known, "f", "left_anti"), own.join(known, "f", "left_semi")
    dealt = listed(short).repartition(tasks_for(spark, pairs, 10 * PAIRS_AT_ONCE), "f")
    lists = dealt.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("l")).select(F.col("l.b").alias("bs"), F.col("l.v").alias("vs"))
    each = lists.select("bs", "vs", F.posexplode("bs").alias("_i", "a")).withColumn("w", F.get("vs", F.col("_i")))
    rest = (lambda c: F.slice(c, F.col("_i") + 2, F.size(c)).alias(c)) if later else F.col
    found = (each.where(F.col("_i") < F.size("bs") - 1) if later else each).select("a", "w", rest("bs"), rest("vs"))
    if long is not None:
        parted, lists, _ = _parts(long, listed(long))
        met = parted.join(lists, ["f", "part"])
        if later:
            met = met.withColumn("l", F.filter(F.arrays_zip("bs", "vs"), lambda x: x["bs"] > F.col("a"))).where(F.size("l") > 0).withColumns({"bs": F.col("l.bs"), "vs": F.col("l.vs")})
        found = found.unionByName(met.select("a", "w", "bs", "vs"))
    return found, pairs, most


def similar(edges: DataFrame, method: str = "both", k: int = 20, threshold: float = 0.0, entity: str = "entity", feature: str = "feature", weight: str = "weight", used: DataFrame | None = None) -> DataFrame:
    """What ``similarity`` gives of ``pair_scores``, without a table of pairs: (entity, neighbor, similarity_score, rank, method).

    Every edge takes the list of its feature's entities to its own entity, in one shuffle; there pairs are added up and ranked,
    in as many tasks as their number wants. Names are compared as texts.

    Entities with the same features and weights have the same neighbours but for themselves. If that halves their number at
    least, one of each kind is compared, with the first k + 1 of each kind: no more of it can be among the k best of anyone.
    """
    scores = {"unweighted": "shared_count", "weighted": "weighted_score"}
    if method != "both" and method not in scores:
        raise ValueError(f"unknown method: {method}")
    scores = {m: s for m, s in scores.items() if method in (m, "both")}
    own = _links(edges, entity, feature, weight, used)
    name = own.schema["a"].dataType
    own, scale, whole = _compact(own)
    members, mine, listed = None, own, own.select(F.col("a").alias("b"), "f", F.col("w").alias("v"))
    if k > 0:
        members = stored(_profiles(own), "profiles")
        entities, kinds = members.agg(F.count("*"), F.count_if(F.col("a") == F.col("rep"))).first()
        if 2 * kinds > entities:
            members = None
    if members is not None:
        first = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("a").cast("string")))
        shown = members.withColumn("at", first).where(F.col("at") <= k + 1).select(F.col("a").alias("b"), F.col("rep").alias("a"))
        own = stored(mine.join(members.where("a = rep").select("a", (F.col("n") > 1).alias("many")), "a"), "kinds")
        listed = stored(own.join(shown, "a").select("b", "f", F.col("w").alias("v")), "listed")
        parted, lists, pairs = _parts(own, listed)
        sent = parted.join(lists, ["f", "part"]).drop("f", "part")
    else:
        sent, pairs, _ = _met(own)
        sent = sent.withColumn("many", F.lit(False))
    if "weighted" not in scores:
        sent = sent.drop("w", "vs")
    sent = sent.repartition(tasks_for(own.sparkSession, pairs, PAIRS_AT_ONCE), "a")
    room = k if members is None else k + 1
    if isinstance(name, T.LongType) and (whole or "weighted" not in scores):
        found = _ranked(sent, list(scores), room if k > 0 else 0, threshold, scale)
    else:
        found = _ranked_names(sent, list(scores), room if k > 0 else 0, threshold, scale)
    if members is None:
        return found.select(F.col("a").cast(name).alias("entity"), F.col("neighbor").cast(name).alias("neighbor"), "similarity_score", "rank", "method")
    best = found.groupBy("a", "method").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "similarity_score"))).alias("l"))  # k + 1 at most
    each = members.select(F.col("a").alias("entity"), F.col("rep").alias("a")).join(best, "a")
    others = F.slice(F.filter("l", lambda x: x["neighbor"] != F.col("entity")), 1, k)
    placed = each.select("entity", "method", F.posexplode(others).alias("at", "x"))
    return placed.select(F.col("entity").cast(name).alias("entity"), F.col("x.neighbor").cast(name).alias("neighbor"), F.col("x.similarity_score").alias("similarity_score"), (F.col("at") + 1).alias("rank"), "method")


def _ranked(sent: DataFrame, scores: list[str], room: int, threshold: float, scale: int) -> DataFrame:
    """(a, neighbor, similarity_score, rank, method) of numbered entities with whole weights: a task adds up and ranks its pairs as arrays.

    It holds the different neighbours of its entities, which are dealt out by the number of pairs.
    """
    best = sent.mapInArrow(partial(meeting.ranked, scores=scores, room=room, threshold=threshold, unit=float(10**scale)), "a long, neighbor long, value long, rank int, method string")
    double = F.when(F.col("method") == "weighted", F.col("value").cast("double") / F.lit(float(10**scale))).otherwise(F.col("value").cast("double"))
    return best.select("a", "neighbor", F.round(double, 6).alias("similarity_score"), "rank", "method")


def _ranked_names(sent: DataFrame, scores: list[str], room: int, threshold: float, scale: int) -> DataFrame:
    """What ``_ranked`` gives, for entities of any type and weights of any."""
    met = sent.select("*", F.posexplode("bs").alias("_i", "b")).where((F.col("a") != F.col("b")) | F.col("many"))
    sums = [F.count("*").alias("shared_count")] if "unweighted" in scores else []
    if "weighted" in scores:
        sums.append(F.sum(F.least("w", F.get("vs", F.col("_i")))).alias("weighted_score"))
    summed = met.groupBy("a", "b").agg(*sums)
    value = {"unweighted": F.col("shared_count"), "weighted": F.col("weighted_score")}
    double = {"unweighted": F.col("shared_count").cast("double"), "weighted": F.col("weighted_score").cast("double") / F.lit(float(10**scale))}
    ranked, hits = summed, []
    for m in scores:
        fits = double[m] >= F.lit(threshold)
        by = F.desc(F.when(fits, value[m])) if len(scores) > 1 else F.desc(value[m])
        ranked = (ranked if len(scores) > 1 else ranked.where(fits)).withColumn(m, F.row_number().over(Window.partitionBy("a").orderBy(by, F.col("b").cast("string"))))
        if room > 0:
            fits = fits & (F.col(m) <= room)
        hits.append((fits, F.struct(F.col("b").alias("neighbor"), F.round(double[m], 6).alias("similarity_score"), F.col(m).alias("rank"), F.lit(m).alias("method"))))
    if len(hits) == 1:
        return ranked.where(hits[0][0]).select("a", hits[0][1].alias("h")).select("a", "h.*")
    return ranked.where(hits[0][0] | hits[1][0]).select("a", F.explode(F.array_compact(F.array(*[F.when(fits, hit) for fits, hit in hits]))).alias("h")).select("a", "h.*")


def kind_pairs(edges: DataFrame, entity: str = "entity", feature: str = "feature", weight: str = "weight", used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``pair_scores`` gives without a row for each pair of copies: (pairs, members).

    members: entity, rep, n, the least entity with the same features and weights and how many there are of these. pairs: a, b,
    shared_count, weighted_score of reps, a < b, and n_pairs, how many pairs of entities have this score; a = b for pairs of
    entities of one kind.
    """
    own = _links(edges, entity, feature, weight, used)
    members = stored(_profiles(own).withColumnRenamed("a", "entity"), "members")
    kinds = members.where("entity = rep").select("rep", "n")
    mine = stored(own.join(kinds.select(F.col("rep").alias("a"), "n"), "a"), "kinds")
    scores = pair_scores(mine, "a", "f", "w")
    within = mine.where("n > 1").groupBy("a").agg(F.count("*").alias("shared_count"), F.sum("w").cast(scores.schema["weighted_score"].dataType).alias("weighted_score"))
    size = lambda end: kinds.select(F.col("rep").alias(end), F.col("n").alias(f"_{end}"))
    between = scores.join(size("a"), "a").join(size("b"), "b").withColumn("n_pairs", F.col("_a") * F.col("_b"))
    alike = within.join(size("a"), "a").withColumn("b", F.col("a")).withColumn("n_pairs", F.expr("_a * (_a - 1) div 2"))
    columns = ("a", "b", "shared_count", "weighted_score", "n_pairs")
    return between.select(*columns).unionByName(alike.select(*columns)), members


def each_pair(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of entities that pairs of kinds stand for, a < b: other columns are those of their kinds."""
    of = lambda end: members.select(F.col("rep").alias(end), F.col("entity").alias(f"_{end}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").where("a <> b or _a < _b")
    return met.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")}).drop("_a", "_b")


def kind_degrees(pairs: DataFrame, members: DataFrame, weight: str) -> DataFrame:
    """(node, degree, strength) of every entity in a pair, from pairs of kinds."""
    sizes = members.where("entity = rep").select("rep", F.col("n").alias("_n"))
    ways = pairs.select("a", "b", weight).unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), weight))
    met = ways.join(sizes.withColumnRenamed("rep", "b"), "b").withColumn("_n", F.when(F.col("a") == F.col("b"), F.col("_n") - 1).otherwise(F.col("_n")))
    kinds = met.groupBy("a").agg(F.sum("_n").alias("degree"), F.sum(F.col("_n") * F.col(weight)).alias("strength"))
    return members.select(F.col("entity").alias("node"), F.col("rep").alias("a")).join(kinds, "a").select("node", "degree", "strength")
