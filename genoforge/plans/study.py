"""A study: the tables that masks filter and commands read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hwe_exact


#: Bases of a piece of the reference.
PIECE = 64


@dataclass(frozen=True)
class Study:
    """Long tables; a genotype that is stored nowhere is homozygous for the reference, so only carriers and missing take rows.

    variants (var_id, chr, bp1, name, ref, alt, qual, filter), calls (file_id, var_id, indiv_id, ac, dp, gq, is_null),
    geno (var_id, indiv_id, ac; null is missing), indiv (indiv_id, sex, aff, qt, strata, factor, pat, mat),
    loci (loc_id, group_id, chr, bp1, bp2, altname), sets (loc_id, set_name, superset_name),
    refs (grp, var_id, chr, bp1, name, alt), edges (a, b, score), seqs (doc_id, seq), segments (indiv_id, seg, t1, t2, n),
    pheno (indiv_id, pheno, value), var_sets (var_id, set_name, superset_name), proteins (transcript, source, feature,
    chr, bp1, bp2), sites (file_id, var_id, filter: what a file says of a variant), groups (group, var_id: what a mask
    grouped), metas (var_id, grp, key, value: fields that are attached on demand), transcripts (transcript,
    gene, kind, chr, bp1, bp2, strand, frame: exons, coding parts and stop codons), reference (chr, piece, seq: PIECE bases each), ibd (id1, id2,
    chr, bp1, bp2: segments that two people share).
    """

    variants: DataFrame
    calls: DataFrame
    geno: DataFrame
    indiv: DataFrame
    loci: DataFrame | None = None
    sets: DataFrame | None = None
    refs: DataFrame | None = None
    edges: DataFrame | None = None
    seqs: DataFrame | None = None
    segments: DataFrame | None = None
    pheno: DataFrame | None = None
    var_sets: DataFrame | None = None
    proteins: DataFrame | None = None
    sites: DataFrame | None = None
    groups: DataFrame | None = None
    metas: DataFrame | None = None
    transcripts: DataFrame | None = None
    reference: DataFrame | None = None
    ibd: DataFrame | None = None

    def but(self, **tables: DataFrame) -> Study:
        return replace(self, **tables)


def consensus(calls: DataFrame) -> DataFrame:
    """Genotypes over files: missing calls don't count, calls that disagree make a missing genotype."""
    called = F.when(~F.col("is_null"), F.col("ac"))
    return calls.groupBy("var_id", "indiv_id").agg(F.min(called).alias("low"), F.max(called).alias("high")).select("var_id", "indiv_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("ac"))


def people(indiv: DataFrame) -> DataFrame:
    """One row: n, na (cases), nu (controls)."""
    return indiv.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("aff") == 2, 1)).alias("na"), F.count(F.when(F.col("aff") == 1, 1)).alias("nu"))


def ranked(study: Study, strata: bool = True, every: bool = False) -> DataFrame:
    """(indiv_id, aff, rank, of, cases): each person's place in the stratum, the stratum's size and its cases; `every`: also people who are neither case nor control."""
    people = study.indiv if every else study.indiv.where("aff in (1, 2)")
    kept = people.select("indiv_id", "aff", (F.coalesce(F.col("strata").cast("string"), F.lit("")) if strata else F.lit("")).alias("stratum"))
    ranks = kept.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy("indiv_id")) - 1)
    sizes = kept.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"), F.count(F.when(F.col("aff") == 2, 1)).alias("cases"))
    return ranks.join(sizes, "stratum").drop("stratum")


def counted(study: Study) -> DataFrame:
    """Variants with genotype counts of all, cases (a_) and controls (u_), allele totals and frequencies.

    The join to individuals carries (indiv_id, aff) only; counts are summed by variant before any other join.
    mac and maf are those of ALT unless it is the commoner allele; at a half ALT counts as minor.
    """
    # Genotypes come and go with the people in the mask, hence the inner join.
    g = study.geno.join(study.indiv.select("indiv_id", "aff"), "indiv_id")
    count = lambda ac, aff: F.count(F.when((F.col("ac").isNull() if ac is None else F.col("ac") == ac) & (F.lit(True) if aff is None else F.col("aff") == aff), 1))
    sums = g.groupBy("var_id").agg(*[count(ac, aff).alias(f"{tag}{name}") for tag, aff in (("", None), ("a_", 2), ("u_", 1)) for name, ac in (("het", 1), ("hom", 2), ("nul", None))])
    names = [f"{tag}{name}" for tag in ("", "a_", "u_") for name in ("het", "hom", "nul")]
    out = study.variants.join(sums, "var_id", "left").fillna(0, names).crossJoin(F.broadcast(people(study.indiv)))  # one row
    for tag, n in (("", "n"), ("a_", "na"), ("u_", "nu")):
        out = out.withColumn(f"{tag}ac", F.col(f"{tag}het") + 2 * F.col(f"{tag}hom")).withColumn(f"{tag}tot", 2 * (F.col(n) - F.col(f"{tag}nul")))
        out = out.withColumn(f"{tag}rr", F.col(n) - F.col(f"{tag}nul") - F.col(f"{tag}het") - F.col(f"{tag}hom"))
    out = out.withColumn("aaf", F.when(F.col("tot") > 0, F.col("ac") / F.col("tot"))).withColumn("flip", F.coalesce(F.col("aaf") > 0.5, F.lit(False)))
    return out.withColumn("mac", F.when(F.col("flip"), F.col("tot") - F.col("ac")).otherwise(F.col("ac"))).withColumn("maf", F.when(F.col("flip"), 1 - F.col("aaf")).otherwise(F.col("aaf")))


def with_hwe(counts: DataFrame) -> DataFrame:
    """counts with the exact p; each distinct triple of counts is tested once."""
    keys = counts.select("het", "hom", "rr").distinct()
    return counts.join(keys.withColumn("hwe", hwe_exact("het", "hom", "rr")), ["het", "hom", "rr"])


def neighbours(variants: DataFrame, within: int = 100) -> DataFrame:
    """var_id and nsnp, the distinct other positions at most `within` bases away."""
    sites = variants.select("chr", "bp1").distinct()
    near = Window.partitionBy("chr").orderBy("bp1").rangeBetween(-within, within)
    return variants.select("var_id", "chr", "bp1").join(sites.withColumn("nsnp", F.count(F.lit(1)).over(near) - 1), ["chr", "bp1"]).select("var_id", "nsnp")
