"""Segments that pairs of people share: what partners say of a proband's sites, and case sharing around rare variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.study import Study, ranked
from .intervals import overlaps, points_in
from .replicates import label_sums, labelled, ordered, summed


def both_ways(ibd: DataFrame) -> DataFrame:
    """(indiv_id, partner, chr, bp1, bp2): each shared segment (id1, id2, chr, bp1, bp2) as either person sees it."""
    one = ibd.select(F.col("id1").alias("indiv_id"), F.col("id2").alias("partner"), "chr", "bp1", "bp2")
    return one.union(one.select("partner", "indiv_id", "chr", "bp1", "bp2")).where("indiv_id <> partner").distinct()


def genotype(study: Study, pairs: DataFrame, who: str, ac: str) -> DataFrame:
    """pairs (var_id, who) with the person's ALT count: 0 where no row is stored, null where it is missing."""
    g = study.geno.select("var_id", F.col("indiv_id").alias(who), F.col("ac").alias(ac), F.lit(True).alias("_stored"))
    return pairs.join(g, ["var_id", who], "left").withColumn(ac, F.when(F.col("_stored").isNull(), 0).otherwise(F.col(ac))).drop("_stored")


def mutation_screen(study: Study, probands: DataFrame) -> DataFrame:
    """(proband, var_id, chr, bp1, ac, n_ibd, n_inform, n_invalid, n_a1, n_a2, n_hethet) around regions of probands (proband, chr, bp1, bp2).

    The window is the region and all segments that meet it. At each site, the partners whose segment holds it are counted:
    all, those where both genotypes are there, opposite homozygotes, and for a heterozygous proband the
    partners that imply REF or ALT on the shared haplotype, or are heterozygous, too. A partner with several segments in
    a region counts with the last.
    """
    seg = both_ways(study.ibd).join(study.indiv.select(F.col("indiv_id").alias("partner")), "partner", "left_semi")
    met = overlaps(probands, seg).where("a_proband = b_indiv_id")
    last = met.groupBy(F.col("a_proband").alias("proband"), F.col("a_chr").alias("chr"), F.col("a_bp1").alias("r1"), F.col("a_bp2").alias("r2"), F.col("b_partner").alias("partner"))
    partners = last.agg(F.max(F.struct("b_bp1", "b_bp2")).alias("s"), F.min("b_bp1").alias("low"), F.max("b_bp2").alias("high"))
    window = partners.groupBy("proband", "chr", "r1", "r2").agg(F.least("r1", F.min("low")).alias("bp1"), F.greatest("r2", F.max("high")).alias("bp2")).select("proband", "chr", "bp1", "bp2")
    sites = points_in(study.variants.select("var_id", "chr", "bp1"), window).select(F.col("i_proband").alias("proband"), "var_id", "chr", "bp1").distinct()
    held = partners.select("proband", "chr", "partner", F.col("s.b_bp1").alias("s1"), F.col("s.b_bp2").alias("s2"))
    seen = sites.join(held, ["proband", "chr"], "left").withColumn("inside", F.col("bp1").between(F.col("s1"), F.col("s2")))
    seen = seen.withColumn("partner", F.when(F.col("inside"), F.col("partner"))).drop("s1", "s2").distinct()
    both = genotype(study, genotype(study, seen, "proband", "ac"), "partner", "other")
    yes = lambda c: F.count(F.when(F.col("inside") & c, 1))
    x, y = F.col("ac"), F.col("other")
    return both.groupBy("proband", "var_id", "chr", "bp1", "ac").agg(
        yes(F.lit(True)).alias("n_ibd"), yes(x.isNotNull() & y.isNotNull()).alias("n_inform"), yes(((x == 0) & (y == 2)) | ((x == 2) & (y == 0))).alias("n_invalid"),
        yes((x == 1) & (y == 0)).alias("n_a1"), yes((x == 1) & (y == 2)).alias("n_a2"), yes((x == 1) & (y == 1)).alias("n_hethet"))


#: Keys of the partners' permutations lie so far from those of the carriers'.
APART = 1_000_003


def s_assoc(study: Study, replicates: int = 99, strata: bool = True) -> DataFrame:
    """(loc_id, nvar, burden, aa, au, p_burden, p_sharing) of loci with two variants at least.

    burden: ALT carriers among cases of variants that no control carries. aa and au: case and control partners of the
    case carriers of variants that a case carries, in segments that hold the variant. In a replicate the labels
    decide anew which variants count, and other labels which partners are cases; who is a case carrier stays. p is
    (replicates that reach the burden, or aa - au, + 1) / (replicates + 1), labels permuted within strata.
    """
    people = ranked(study, strata)
    met = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select(F.col("i_loc_id").alias("loc_id"), "var_id").distinct()
    size = met.groupBy("loc_id").agg(F.count(F.lit(1)).alias("nvar")).where("nvar >= 2")
    geno = study.geno.where("ac > 0").select("var_id", "indiv_id")
    case = geno.join(people.where("aff = 2").select("indiv_id"), "indiv_id", "left_semi").join(study.variants.select("var_id", "chr", "bp1"), "var_id")
    # A case carrier's segments are few: they join by person before the bounds are compared.
    seg = both_ways(study.ibd).select("indiv_id", "partner", F.col("chr").alias("s_chr"), F.col("bp1").alias("s1"), F.col("bp2").alias("s2"))
    shared = case.join(seg, "indiv_id").where((F.col("chr") == F.col("s_chr")) & F.col("bp1").between(F.col("s1"), F.col("s2"))).select("var_id", F.col("partner").alias("indiv_id"))
    own = label_sums(geno.join(labelled(people, replicates), "indiv_id"), "var_id", replicates)
    partners = label_sums(shared.join(labelled(people, replicates, APART), "indiv_id"), "var_id", replicates).select("var_id", F.col("n").alias("pn"), F.col("ca").alias("pa"))
    each = met.join(size, "loc_id", "left_semi").join(own.join(partners, "var_id", "left"), "var_id").select("loc_id", "n", "ca", "pn", "pa")

    def rows(pdf: pd.DataFrame) -> np.ndarray:
        none = np.zeros(replicates + 1, np.int32)
        ca, pa = np.stack(pdf["ca"]), np.stack([none if x is None else x for x in pdf["pa"]])
        alone, some = ca == pdf["n"].to_numpy()[:, None], ca > 0
        return np.concatenate([ca * alone, pa * some, (pdf["pn"].fillna(0).to_numpy(np.int64)[:, None] - pa) * some], axis=1)

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sums in summed(batches, "loc_id", rows):
            burden, aa, au = np.split(sums, 3, axis=1)
            gain = aa - au
            yield pd.DataFrame({"loc_id": keys, "burden": burden[:, 0], "aa": aa[:, 0], "au": au[:, 0], "rb": (burden[:, 1:] >= burden[:, :1]).sum(1), "rd": (gain[:, 1:] >= gain[:, :1]).sum(1)})

    found = size.join(ordered(each, "loc_id").mapInPandas(tested, "loc_id long, burden long, aa long, au long, rb long, rd long"), "loc_id", "left")
    # In a locus without a carrier, burden and difference are 0 in all replicates.
    found = found.fillna(0, ["burden", "aa", "au"]).fillna(replicates, ["rb", "rd"])
    p = lambda r: (F.col(r) + 1) / F.lit(replicates + 1.0)
    return found.select("loc_id", "nvar", "burden", "aa", "au", p("rb").alias("p_burden"), p("rd").alias("p_sharing"))
