"""The best rows of each group, for groups of any size: thresholds by histograms instead of a sort of each group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgraph.storage import stored

#: What is known of each group is broadcast up to so many groups (about 100 bytes each, 20 MB), else joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Undecided rows of a group are put in order at once when they are no more than this.
SMALL = 50_000
_BINS = 1024


def about_groups(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """``rows`` with the columns of ``groups``, a row for each group; groups that aren't there drop out."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, group)


def best_of_each(rows: DataFrame, quotas: DataFrame, group: str, keys: tuple[str, ...], ties: tuple[Column, ...] = (), small: int = SMALL) -> DataFrame:
    """The first ``quota`` rows of each group by ``keys`` (columns of numbers, greatest first), then by ``ties``.

    ``quotas``: group, quota. Equal groups are one group; rows of a null group, and groups without a quota, drop out; nulls and
    NaN among the keys aren't expected.

    Each pass bins a key over the range that a group's undecided rows have. Rows above the bin that holds the group's last place
    are taken, those below it left out, and those within it decided by the next pass: over a narrower range, or by the next key
    when all are equal. When a group has few undecided rows, these are put in order. No task holds a group but for rows that are
    equal in all keys, of which each task passes on no more than the greatest quota.
    """
    names = rows.columns
    share = stored(quotas.where("quota > 0").select(group, F.col("quota").alias("_need_")), "quotas")
    open_, taken = about_groups(rows, share, group), []
    for key in keys:
        for _ in range(8):
            value = F.col(key).cast("double")
            ranges = stored(open_.groupBy(group).agg(F.min(value).alias("_low_"), F.max(value).alias("_high_"), F.count("*").alias("_size_")), "ranges")
            largest, apart = ranges.agg(F.max("_size_"), F.count_if(F.col("_low_") < F.col("_high_"))).first()
            if (largest or 0) <= small or not apart:
                break
            place = F.when(F.col("_high_") > F.col("_low_"), F.floor((value - F.col("_low_")) / (F.col("_high_") - F.col("_low_")) * (_BINS - 1))).otherwise(0).cast("int")
            binned = about_groups(open_, ranges, group).withColumn("_bin_", place)
            histogram = binned.groupBy(group, "_need_", "_size_", "_bin_").agg(F.count("*").alias("_n_"))
            above = F.coalesce(F.sum("_n_").over(Window.partitionBy(group).orderBy(F.desc("_bin_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            last = F.least("_need_", "_size_")  # the place of the last row taken
            cuts = histogram.withColumn("_above_", above).where((F.col("_above_") < last) & (last <= F.col("_above_") + F.col("_n_")))
            cuts = stored(cuts.select(group, F.col("_bin_").alias("_cut_"), (last - F.col("_above_")).alias("_left_"), (F.col("_above_") + F.col("_n_") == last).alias("_all_")), "cuts")
            judged = about_groups(binned.drop("_low_", "_high_", "_size_"), cuts, group).where(F.col("_bin_") >= F.col("_cut_"))
            judged = stored(judged.withColumn("_in_", (F.col("_bin_") > F.col("_cut_")) | F.col("_all_")), "judged")
            taken.append(judged.where("_in_").select(*names))
            open_ = judged.where(~F.col("_in_")).select(*names, F.col("_left_").alias("_need_"))
        if (largest or 0) <= small:
            break
    most = open_.agg(F.max("_need_")).first()[0] or 0
    at = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(k) for k in keys], *ties))
    rest = open_.withColumn("_at_", at).where((F.col("_at_") <= most) & (F.col("_at_") <= F.col("_need_")))
    return reduce(DataFrame.unionByName, taken, rest.select(*names))
