"""Counts, frequencies and summary statistics of variants, loci and individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import is_transition, is_transversion
from ..plans.study import Study, counted, neighbours, with_hwe
from .intervals import points_in


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles with so many decimals, so that results don't depend on the order of addition; ties lean upwards."""
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def counts_by_locus(study: Study, group: int, most: float) -> DataFrame:
    """Case and control counts of the PASS variants with an ALT frequency of at most `most`, by locus of a group."""
    v = counted(study.but(variants=study.variants.where("filter = 'PASS'"))).where(F.col("aaf").between(0.0, most))
    met = points_in(v.select("var_id", "chr", "bp1", "a_ac", "u_ac", "a_tot", "u_tot"), study.loci.where(F.col("group_id") == group))
    return met.select(F.col("i_loc_id").alias("loc_id"), "var_id", "chr", "bp1", F.col("a_ac").alias("a_alt"), F.col("u_ac").alias("u_alt"), "a_tot", "u_tot")


def v_freq(study: Study) -> DataFrame:
    """Frequencies of each variant: call rate, minor allele count and frequency, heterozygosity, exact HWE p, neighbours."""
    v = with_hwe(counted(study)).join(neighbours(study.variants), "var_id")
    return v.select("var_id", "chr", "bp1", "ref", "alt", "filter", "qual", is_transition(F.col("ref"), F.col("alt")).alias("ti"), (1 - F.col("nul") / F.col("n")).alias("geno"),
        "mac", "maf", F.col("flip").alias("refmin"), "hwe", (F.col("het") / (F.col("n") - F.col("nul"))).alias("het"), "nsnp")


def counts(study: Study) -> DataFrame:
    """Minor allele counts and allele totals of cases and controls."""
    minor = lambda t: F.when(F.col("flip"), F.col(f"{t}tot") - F.col(f"{t}ac")).otherwise(F.col(f"{t}ac"))
    return counted(study).select("var_id", "ref", "alt", F.when(F.col("flip"), F.col("ref")).otherwise(F.col("alt")).alias("minor"), minor("a_").alias("cnta"), minor("u_").alias("cntu"), F.col("a_tot").alias("tota"), F.col("u_tot").alias("totu"))


def g_counts(study: Study) -> DataFrame:
    """Genotype label counts `label=cases:controls` of each variant."""
    label = lambda a, b, k: F.concat(a, F.lit("/"), b, F.lit("="), F.col(f"a_{k}").cast("string"), F.lit(":"), F.col(f"u_{k}").cast("string"))
    r, a = F.col("ref"), F.col("alt")
    return counted(study).select("var_id", "ref", "alt", F.concat_ws(" ", label(r, r, "rr"), label(r, a, "het"), label(a, a, "hom"), label(F.lit("."), F.lit("."), "nul")).alias("genotypes"))


def means(study: Study) -> DataFrame:
    """Quantitative trait of reference homozygotes and of ALT carriers: mean, variance, deviation, number.

    Homozygotes have no rows, so theirs are the sums of all people less those of carriers and missing.
    """
    g = study.geno.join(study.indiv.select("indiv_id", "qt"), "indiv_id").where("qt is not null")
    has = F.col("ac") > 0
    off = F.col("ac").isNull() | has
    part = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    q = F.col("qt")
    sums = g.groupBy("var_id").agg(part(has, 1.0).alias("k"), part(has, q).alias("s"), part(has, q * q).alias("s2"), part(off, 1.0).alias("ok"), part(off, q).alias("os"), part(off, q * q).alias("os2"))
    every = study.indiv.agg(F.count("qt").cast("double").alias("n"), F.sum("qt").alias("t"), F.sum(q * q).alias("t2"))
    v = study.variants.select("var_id", "ref", "alt").join(sums, "var_id", "left").fillna(0.0).crossJoin(F.broadcast(every))  # one row
    rn, rs, rs2 = F.col("n") - F.col("ok"), F.col("t") - F.col("os"), F.col("t2") - F.col("os2")
    var = lambda n, s, s2: F.when(n > 1, (s2 - s * s / n) / (n - 1))
    k, s, s2 = F.col("k"), F.col("s"), F.col("s2")
    return v.select("var_id", "ref", "alt", F.when(rn > 0, rs / rn).alias("refmean"), var(rn, rs, rs2).alias("refvar"), F.sqrt(var(rn, rs, rs2)).alias("refsd"), rn.cast("long").alias("refn"),
        F.when(k > 0, s / k).alias("altmean"), var(k, s, s2).alias("altvar"), F.sqrt(F.greatest(var(k, s, s2), F.lit(0.0))).alias("altsd"), k.cast("long").alias("altn"))


def _stats() -> list[Column]:
    ti, tv = is_transition(F.col("ref"), F.col("alt")), is_transversion(F.col("ref"), F.col("alt"))
    single = F.col("mac") == 1
    yes = lambda c: F.count(F.when(c, 1))
    ratio = lambda a, b: F.when(yes(b) > 0, yes(a) / yes(b))
    return [
        F.count(F.lit(1)).alias("nvar"), F.avg(1 - F.col("nul") / F.col("n")).alias("rate"), F.avg("mac").alias("mac"), F.avg("maf").alias("maf"), yes(single).alias("sing"),
        yes((F.col("ac") == 0) | (F.col("ac") == F.col("tot"))).alias("mono"), ratio(ti, tv).alias("titv"), ratio(ti & single, tv & single).alias("titv_s"), F.avg("qual").alias("qual"),
        F.avg((F.col("filter") == "PASS").cast("double")).alias("pass"), ratio((F.col("filter") == "PASS") & single, single).alias("pass_s")]


def v_stats(study: Study) -> DataFrame:
    """One row of statistics over all variants."""
    return counted(study).agg(*_stats())


def g_stats(study: Study) -> DataFrame:
    """The same by locus, with its length in kb and bases for each variant."""
    met = points_in(counted(study), study.loci)
    by = met.groupBy("i_loc_id", "i_altname", "i_chr", "i_bp1", "i_bp2").agg(*_stats())
    length = F.col("i_bp2") - F.col("i_bp1") + 1
    return by.select(F.col("i_loc_id").alias("loc_id"), F.col("i_altname").alias("name"), (length / 1000).alias("kb"), (length / F.col("nvar")).alias("dens"), "nvar", "rate", "mac", "maf", "sing", "mono", "titv", "qual", "pass")


def i_stats(study: Study) -> DataFrame:
    """Of each individual: ALT genotypes, heterozygotes, missing, singletons, and mean MAF and quality of the variants whose minor allele is carried.

    Where ALT is the commoner allele all but ALT homozygotes and missing genotypes carry the minor one: the sums over
    these variants less those of the genotypes that don't.
    """
    v = counted(study).select("var_id", "flip", "mac", "maf", "qual")
    g = study.geno.join(v, "var_id")
    yes = lambda c: F.count(F.when(c, 1))
    sign = F.when(~F.col("flip") & (F.col("ac") > 0), 1).when(F.col("flip") & (F.col("ac").isNull() | (F.col("ac") == 2)), -1).otherwise(0)
    part = lambda c: F.sum(sign * F.col(c))
    by = g.groupBy("indiv_id").agg(yes(F.col("ac") > 0).alias("nalt"), yes(F.col("ac") == 1).alias("nhet"), yes(F.col("ac").isNull()).alias("nmiss"),
        yes((F.col("ac") > 0) & (F.col("mac") == 1)).alias("sing"), F.sum(sign).alias("k"), part("maf").alias("m"), part("qual").alias("q"))
    whole = v.where("flip").agg(F.count(F.lit(1)).alias("k0"), F.coalesce(F.sum("maf"), F.lit(0.0)).alias("m0"), F.coalesce(F.sum("qual"), F.lit(0.0)).alias("q0"))
    out = study.indiv.select("indiv_id", "aff").join(by, "indiv_id", "left").fillna(0, ["nalt", "nhet", "nmiss", "sing", "k", "m", "q"]).crossJoin(F.broadcast(whole))  # one row
    n = F.col("k") + F.col("k0")
    return out.select("indiv_id", "aff", "nalt", "nhet", "nmiss", "sing", F.when(n > 0, (F.col("m") + F.col("m0")) / n).alias("maf"), F.when(n > 0, (F.col("q") + F.col("q0")) / n).alias("qual"))


def v_dist(study: Study, most: int = 4, strata: bool = True) -> DataFrame:
    """Variants whose ALT is seen 1..most times, by how many of these are in cases, against a binomial split."""
    groups = study.indiv.select("indiv_id", "aff", F.lit("all").alias("stratum"))
    if strata:
        groups = groups.union(study.indiv.select("indiv_id", "aff", F.col("strata").cast("string")))
    share = groups.groupBy("stratum").agg(F.avg((F.col("aff") == 2).cast("double")).alias("p"))
    seen = study.geno.where("ac > 0").join(groups, "indiv_id").groupBy("stratum", "var_id").agg(F.sum("ac").alias("k"), F.sum(F.when(F.col("aff") == 2, F.col("ac")).otherwise(0)).alias("j"))
    cells = seen.where(F.col("k").between(1, most)).groupBy("stratum", "k", "j").agg(F.count(F.lit(1)).alias("observed"))
    total = cells.groupBy("stratum", "k").agg(F.sum("observed").alias("nk"))
    grid = total.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), "k"))).join(cells, ["stratum", "k", "j"], "left").fillna(0, ["observed"]).join(share, "stratum")
    choose = F.factorial("k") / (F.factorial("j") * F.factorial(F.col("k") - F.col("j")))
    grid = grid.withColumn("expected", choose * F.pow("p", "j") * F.pow(1 - F.col("p"), F.col("k") - F.col("j")) * F.col("nk"))
    gap = F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected")
    return grid.select("stratum", "k", "j", "observed", "expected", F.when(F.col("expected") > 0, gap).otherwise(0.0).alias("chi2"))


def unique(study: Study, require: int = 2, allow: int = 0) -> DataFrame:
    """Variants whose minor allele is seen in at least `require` cases and at most `allow` controls."""
    carry = lambda t: F.when(F.col("flip"), F.col(f"{t}rr") + F.col(f"{t}het")).otherwise(F.col(f"{t}het") + F.col(f"{t}hom"))
    v = counted(study).select("var_id", carry("a_").alias("in_group"), carry("u_").alias("outside"))
    return v.where((F.col("in_group") >= require) & (F.col("outside") <= allow))


def group_comparison(study: Study) -> DataFrame:
    """How many variants have their minor allele carried in exactly which set of strata."""
    sizes = study.indiv.groupBy("strata").agg(F.count(F.lit(1)).alias("n"))
    v = counted(study).select("var_id", "flip")
    g = study.geno.join(study.indiv.select("indiv_id", "strata"), "indiv_id")
    seen = g.groupBy("var_id", "strata").agg(F.count(F.when(F.col("ac") > 0, 1)).alias("alt"), F.count(F.when(F.col("ac").isNull() | (F.col("ac") == 2), 1)).alias("without"))
    rare = seen.join(v.where("not flip"), "var_id").where("alt > 0").select("var_id", "strata")
    # Where ALT is the commoner allele, a stratum carries REF unless all of it is homozygous for ALT or missing.
    common = v.where("flip").select("var_id").crossJoin(F.broadcast(sizes)).join(seen, ["var_id", "strata"], "left").where("n > coalesce(without, 0)").select("var_id", "strata")  # a row for each stratum
    sets = rare.union(common).groupBy("var_id").agg(F.array_join(F.array_sort(F.collect_set("strata")), ",").alias("groups"))
    return sets.groupBy("groups").agg(F.count(F.lit(1)).alias("n"))


def clusters(study: Study) -> DataFrame:
    """People with more variants in a locus than the mean and five deviations of all carriers there."""
    carriers = points_in(study.geno.where("ac > 0").join(study.variants.select("var_id", "chr", "bp1"), "var_id"), study.loci).groupBy(F.col("i_loc_id").alias("loc_id"), "indiv_id").agg(F.count(F.lit(1)).alias("k"))
    w = carriers.groupBy("loc_id").agg(F.avg("k").alias("mean"), F.stddev_pop("k").alias("sd"))
    return carriers.join(w, "loc_id").where(F.col("k") > F.col("mean") + 5 * F.col("sd"))


def i_pop(study: Study) -> DataFrame:
    """Posterior of each individual's population from stratum frequencies under Hardy-Weinberg, and the variants called.

    A person's log likelihood is that of reference homozygotes at all variants, corrected by the stored genotypes.
    """
    sizes = study.indiv.groupBy("strata").agg(F.count(F.lit(1)).alias("n"))
    seen = study.geno.where("ac > 0").join(study.indiv.select("indiv_id", "strata"), "indiv_id").groupBy("var_id", "strata").agg(F.sum("ac").alias("k"))
    f = (F.coalesce("k", F.lit(0)) + 0.5) / (2 * F.col("n") + 1)
    freqs = study.variants.select("var_id").crossJoin(F.broadcast(sizes)).join(seen, ["var_id", "strata"], "left").select("var_id", "strata", f.alias("f"))  # a row for each population
    none = 2 * F.log(1 - F.col("f"))
    whole = freqs.groupBy("strata").agg(F.sum(none).alias("base"), F.count(F.lit(1)).alias("v"))
    g = study.geno.join(study.indiv.select("indiv_id"), "indiv_id").join(freqs, "var_id")
    own = F.when(F.col("ac").isNull(), 0.0).when(F.col("ac") == 0, none).when(F.col("ac") == 1, F.log(2 * F.col("f") * (1 - F.col("f")))).otherwise(2 * F.log("f"))
    by = g.groupBy("indiv_id", "strata").agg(F.sum(own - none).alias("more"), F.count(F.when(F.col("ac").isNull(), 1)).alias("lost"))
    ll = study.indiv.select("indiv_id").crossJoin(F.broadcast(whole)).join(by, ["indiv_id", "strata"], "left").fillna(0, ["more", "lost"])
    ll = ll.select("indiv_id", "strata", (F.col("v") - F.col("lost")).alias("nvar"), (F.col("base") + F.col("more")).alias("ll"))
    one = Window.partitionBy("indiv_id")
    e = F.exp(F.col("ll") - F.max("ll").over(one))
    return ll.withColumn("prob", e / F.sum(e).over(one)).select("indiv_id", F.col("strata").alias("pop"), "nvar", "prob")
