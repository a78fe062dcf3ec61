"""Sites of several files as variants: merge modes, alleles of merged sites, consensus genotypes, one variant for each ALT.

sites: (site_id, file_id, chr, bp1, ref, alt), a row for each record of a file; alt may be a list with commas.
genotypes: (site_id, indiv_id, a1, a2): allele numbers of the record, 0 for REF, null for a missing genotype.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Merge modes: only records equal in REF and ALT; records of one span whose ALTs are equal or all of one length; all that overlap.
MODES = ("no-merge", "exact-merge", "any-merge")


def merged(sites: DataFrame, mode: str = "exact-merge") -> DataFrame:
    """sites with bp2, their alts as an array, and var_id: the smallest site_id of the records that are one variant."""
    rows = sites.withColumn("bp2", F.col("bp1") + F.length("ref") - 1).withColumn("alts", F.split("alt", ","))
    if mode == "no-merge":
        keys = ["chr", "bp1", "ref", "alt"]
    elif mode == "exact-merge":
        lengths = F.array_distinct(F.transform("alts", lambda a: F.length(a)))
        rows = rows.withColumn("kind", F.when(F.size(lengths) == 1, F.get(lengths, F.lit(0)).cast("string")).otherwise(F.col("alt")))
        keys = ["chr", "bp1", "bp2", "kind"]
    elif mode == "any-merge":
        # A record belongs to the island before it if it starts where that still lasts.
        ends = rows.groupBy("chr", "bp1").agg(F.max("bp2").alias("bp2"))
        order = Window.partitionBy("chr").orderBy("bp1")
        before = F.max("bp2").over(order.rowsBetween(Window.unboundedPreceding, -1))
        starts = ends.withColumn("fresh", F.when(F.col("bp1") <= before, 0).otherwise(1))
        islands = starts.select("chr", "bp1", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
        rows = rows.join(islands, ["chr", "bp1"])
        keys = ["chr", "island"]
    else:
        raise ValueError(f"unknown merge mode: {mode}")
    first = rows.groupBy(*keys).agg(F.min("site_id").alias("var_id"))
    return rows.join(first, keys).select("var_id", "site_id", "file_id", "chr", "bp1", "bp2", "ref", "alt", "alts")


def variants(sites: DataFrame) -> DataFrame:
    """(var_id, chr, bp1, bp2, alleles, records, files): merged records as variants; alleles are the different `REF>ALT` at their offsets."""
    start = sites.groupBy("var_id").agg(F.min("chr").alias("chr"), F.min("bp1").alias("start"), F.max("bp2").alias("bp2"), F.countDistinct("site_id").alias("records"), F.countDistinct("file_id").alias("files"))
    each = sites.select("var_id", "bp1", "ref", F.explode("alts").alias("a")).join(start, "var_id")
    allele = F.concat((F.col("bp1") - F.col("start")).cast("string"), F.lit(":"), "ref", F.lit(">"), "a")
    return each.groupBy("var_id", "chr", "start", "bp2", "records", "files").agg(F.array_join(F.array_sort(F.collect_set(allele)), " ").alias("alleles")).withColumnRenamed("start", "bp1")


def consensus(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(var_id, indiv_id, genotype): the alleles of each person in order, as `A/G`; records that disagree make it missing."""
    name = lambda a: F.when(F.col(a) == 0, F.col("ref")).otherwise(F.get("alts", F.col(a) - 1))
    g = genotypes.join(sites.select("site_id", "var_id", "ref", "alts"), "site_id").where("a1 is not null and a2 is not null")
    text = F.concat_ws("/", F.array_sort(F.array(name("a1"), name("a2"))))
    return g.groupBy("var_id", "indiv_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).select("var_id", "indiv_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("genotype"))


def soft_or_hard(sites: DataFrame, genotypes: DataFrame, members: DataFrame, hard: bool) -> DataFrame:
    """(var_id, indiv_id, ac): ALT counts over files; members: (file_id, indiv_id).

    A person of a file without a row is a reference homozygote there. By soft rules that only means that no ALT was
    seen, and an ALT in another file stands; by hard rules it is a call, and the two make a missing genotype.
    """
    ac = (F.col("a1") > 0).cast("int") + (F.col("a2") > 0).cast("int")
    g = genotypes.join(sites.select("site_id", "var_id", "file_id"), "site_id").where("a1 is not null and a2 is not null")
    seen = g.groupBy("var_id", "indiv_id").agg(F.min(ac).alias("low"), F.max(ac).alias("high"), F.min(F.when(ac > 0, ac)).alias("alt_low"), F.collect_set("file_id").alias("with"))
    if not hard:
        return seen.select("var_id", "indiv_id", F.when(F.col("high") == 0, 0).when(F.col("alt_low") == F.col("high"), F.col("high")).alias("ac"))
    covers = sites.groupBy("var_id").agg(F.collect_set("file_id").alias("covers"))
    belongs = members.groupBy("indiv_id").agg(F.collect_set("file_id").alias("files"))
    silent = F.size(F.array_except(F.array_intersect("covers", "files"), "with")) > 0
    both = seen.join(covers, "var_id").join(belongs, "indiv_id")
    return both.select("var_id", "indiv_id", F.when((F.col("low") == F.col("high")) & (~silent | (F.col("high") == 0)), F.col("high")).alias("ac"))


def downcoded(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(var_id, alt, indiv_id, ac): a biallelic variant for each ALT of a record; other ALTs count as reference."""
    g = genotypes.join(sites.select("site_id", "var_id", F.posexplode("alts").alias("k", "alt")), "site_id").where("a1 is not null and a2 is not null")
    ac = (F.col("a1") == F.col("k") + 1).cast("int") + (F.col("a2") == F.col("k") + 1).cast("int")
    return g.select("site_id", "var_id", "alt", "indiv_id", ac.alias("ac")).where("ac > 0")


def allele_counts(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(site_id, alt, n): copies of each ALT among the stored genotypes of a record."""
    each = downcoded(sites, genotypes).groupBy("site_id", "alt").agg(F.sum("ac").alias("n"))
    return sites.select("site_id", F.explode("alts").alias("alt")).join(each, ["site_id", "alt"], "left").fillna(0, ["n"])
