"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a fixed hash of doc_id. Tokens are summed by source and leading hash
digits; the running sum finds the bucket in which a source's budget ends, and only that bucket is summed
again by further digits, until the threshold is one hash. Taking is then a filter, without any sort of
documents. The set of a smaller budget is part of the set of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table, written

#: Hex digits of the hash, and digits by which a round refines a bucket.
DIGITS, STEP = 15, 3


def n_words(text: str | Column) -> Column:
    """Maximal runs of anything but white space."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + 1).cast("long")


def targets(sizes: DataFrame, weights: DataFrame | None = None, most: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with target, a row for each source.

    Weights are given (source, weight), or 1, 2, 3 repeating over the sources by code point, null last.
    Targets share the whole size by weight and stop at `most` times their source's size; what is over goes to
    the others by weight until none is above. Sources reach their stop in the order of size / weight, so one
    running sum over the sources (one row each) finds all that do.
    """
    if weights is None:
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        sized = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1.0)
    else:
        sized = sizes.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.*", "w.weight")
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.lit(float(most)) * F.col("source_size")
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(stop).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    share = sized.select("*", stop.alias("stop"), (rest / open_weight).alias("level")).withColumn("full", F.col("stop") < F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return share.select("source", "source_size", F.when(F.col("full"), F.col("stop")).otherwise(F.least("stop", F.col("weight") * level)).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents (source, size, h) whose hash h is at most the threshold meet the budget (source, budget).

    A hash is taken when the middle of its size in the running sum is within the budget, so the sum is within
    half a hash's size of it. Histograms have 16 ** STEP buckets a source at most, whatever the table's size.
    """
    state = budgets.select("source", "budget", F.lit("").alias("prefix"))
    running = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    for width in range(STEP, DIGITS + 1, STEP):
        inside = docs.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.substring("d.h", 1, width - STEP) == F.col("s.prefix")))
        sums = inside.groupBy("s.source", "s.budget", F.substring("d.h", 1, width).alias("prefix")).agg(F.sum("d.size").alias("mass"))
        sums = sums.withColumn("before", F.coalesce(F.sum("mass").over(running), F.lit(0)))
        if width < DIGITS:
            met = sums.where("before <= budget").groupBy("source").agg(F.max_by(F.struct("prefix", (F.col("budget") - F.col("before")).alias("budget")), "prefix").alias("m"))
            state = written(met.select("source", "m.budget", "m.prefix"), "thresholds")
    # If the bucket's first hash is over already, the bucket's prefix is the threshold: all hashes before it are less.
    within = F.when(F.col("before") + F.col("mass") / 2 <= F.col("budget"), F.col("prefix")).otherwise(F.substring("prefix", 1, DIGITS - STEP))
    return sums.groupBy("source").agg(F.max(within).alias("threshold"))


def mixed(documents: DataFrame, weights: DataFrame | None = None, most: float = 3.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each row of documents (doc_id, text, source).

    A source whose target is at least its size gives every document that many whole times, and the rest by
    threshold. Null texts have size 0; null is a source of its own; rows with one doc_id share a hash and go
    together; null doc_ids hash as ''. Sources of size 0 take 0. An empty table gives no rows.
    """
    h = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, DIGITS)
    docs = written(documents.select("doc_id", "source", n_words("text").alias("size"), h.alias("h")), "sizes")
    goal = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", F.least(whole, F.lit(int(most))))
    budgets = goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")).where("budget > 0")
    cut = written(thresholds(docs.select("source", "size", "h"), budgets), "cuts")
    plan = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.*", "c.threshold")
    copies = (F.col("p.whole") + F.when(F.col("d.h") <= F.col("p.threshold"), 1).otherwise(0)).cast("int")
    return docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * copies).alias("taken"), copies.alias("copies"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS stop,
  (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN stop < weight * level THEN stop
  ELSE least(stop, weight * max(CASE WHEN stop >= weight * level THEN level END) OVER ()) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
b AS (SELECT source, h, sum(mass) OVER (PARTITION BY source ORDER BY h) - mass / 2 AS middle
  FROM (SELECT source, h, sum(size) AS mass FROM d GROUP BY 1, 2))
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target, CAST(d.size * c AS BIGINT) AS taken, CAST(c AS INTEGER) AS copies
FROM (SELECT d.*, g.whole + CASE WHEN g.target - g.whole * g.source_size > 0 AND b.middle <= g.target - g.whole * g.source_size THEN 1 ELSE 0 END AS c
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN b ON b.h = d.h AND b.source IS NOT DISTINCT FROM d.source) d
JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""
