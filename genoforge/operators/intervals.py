"""Joins and set algebra of intervals (chr, bp1, bp2), both ends included.

Range conditions become equi-joins on (chr, bin), so no join compares everything with everything. An interval
longer than MOST_BINS bins is dealt to coarser bins, whose width doubles until it fits: each level of width is
joined for itself, so a chromosome-long interval costs as few rows as a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a bin, of the size of what is looked up most: rows of a bin meet each other before bounds are compared.
WIDTH = 1 << 11
MOST_BINS = 16
LEVELS = range(0, 24, 4)


def _level(low: Column, high: Column) -> Column:
    """The narrowest level at which an interval takes MOST_BINS bins at most."""
    out = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        out = F.when(high - low < WIDTH * MOST_BINS << level, level).otherwise(out)
    return out


def _bin(bp: Column, level: Column) -> Column:
    return F.floor(bp / (F.lit(float(WIDTH)) * F.pow(F.lit(2.0), level))).cast("long")


def points_in(points: DataFrame, intervals: DataFrame, bp: str = "bp1") -> DataFrame:
    """All columns of points (chr, bp) and of the intervals (chr, bp1, bp2; renamed i_...) that contain them.

    A pair appears once, as a point lies in one bin of each level.
    """
    named = intervals.select(*[F.col(c).alias(f"i_{c}") for c in intervals.columns])
    binned = named.withColumn("_level", _level(F.col("i_bp1"), F.col("i_bp2")))
    binned = binned.withColumn("_bin", F.explode(F.sequence(_bin(F.col("i_bp1"), F.col("_level")), _bin(F.col("i_bp2"), F.col("_level")))))
    levelled = points.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _bin(F.col(bp), F.lit(k)).alias("bin")) for k in LEVELS])))
    met = levelled.join(binned, (F.col("chr") == F.col("i_chr")) & (F.col("_p.level") == F.col("_level")) & (F.col("_p.bin") == F.col("_bin")))
    return met.where(F.col(bp).between(F.col("i_bp1"), F.col("i_bp2"))).drop("_p", "_level", "_bin")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of left and right intervals (renamed a_... and b_...) that share a base, with shared and joint length.

    Each interval is dealt to bins of its own level and of all coarser ones; a pair meets at the coarser of its two
    levels, and of the bins that it shares there only the first counts.
    """

    def binned(df: DataFrame, tag: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
        own, first, last = F.col(f"_{tag}_own"), F.col(f"{tag}_bp1"), F.col(f"{tag}_bp2")
        levelled = named.withColumn(f"_{tag}_own", _level(first, last)).withColumn(f"_{tag}_level", F.explode(F.array(*map(F.lit, LEVELS)))).where(F.col(f"_{tag}_level") >= own)
        return levelled.withColumn(f"_{tag}_bin", F.explode(F.sequence(_bin(first, F.col(f"_{tag}_level")), _bin(last, F.col(f"_{tag}_level")))))

    a, b = binned(left, "a"), binned(right, "b")
    low, high = F.greatest("a_bp1", "b_bp1"), F.least("a_bp2", "b_bp2")
    same = (F.col("a_chr") == F.col("b_chr")) & (F.col("_a_level") == F.col("_b_level")) & (F.col("_a_bin") == F.col("_b_bin"))
    met = a.join(b, same & (F.col("_a_level") == F.greatest("_a_own", "_b_own")) & (low <= high) & (F.col("_a_bin") == _bin(low, F.col("_a_level"))))
    shared = met.drop(*[f"_{t}_{x}" for t in "ab" for x in ("own", "level", "bin")])
    return shared.withColumn("intersection", high - low + 1).withColumn("joint", F.greatest("a_bp2", "b_bp2") - F.least("a_bp1", "b_bp1") + 1)


def merged(intervals: DataFrame, keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Overlapping and touching intervals of a key as one, with how many went in."""
    order = Window.partitionBy(*keys).orderBy("bp1", "bp2")
    reach = F.max("bp2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = intervals.select(*keys, "bp1", "bp2").withColumn("_new", F.when(reach.isNull() | (F.col("bp1") > reach + 1), 1).otherwise(0))
    island = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("bp1").alias("bp1"), F.max("bp2").alias("bp2"), F.count(F.lit(1)).alias("n")).drop("_island")


def subtracted(left: DataFrame, right: DataFrame) -> DataFrame:
    """(chr, bp1, bp2): the bases of left that are not in right, as maximal intervals, from a running sum of ends."""
    def ends(df: DataFrame, a: int, b: int) -> DataFrame:
        whole = merged(df)
        return whole.select("chr", F.col("bp1").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")).union(
            whole.select("chr", F.col("bp2") + 1, F.lit(-a), F.lit(-b)))

    steps = ends(left, 1, 0).union(ends(right, 0, 1)).groupBy("chr", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("chr").orderBy("at")
    open_ = steps.select("chr", "at", F.sum("a").over(order).alias("a"), F.sum("b").over(order).alias("b"), F.lead("at").over(order).alias("next"))
    parts = open_.where("a > 0 and b = 0").select("chr", F.col("at").alias("bp1"), (F.col("next") - 1).alias("bp2"))
    return merged(parts).select("chr", "bp1", "bp2")
