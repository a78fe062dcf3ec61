"""What masks do to single genotypes: scores by model, sex chromosomes, hard calls, and calls by estimated frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def models() -> dict[str, Column]:
    """How a genotype of two alleles a1, a2 (0 for REF; a2 null: haploid) scores in each model."""
    x, y, haploid = (F.col("a1") > 0).cast("int"), (F.col("a2") > 0).cast("int"), F.col("a2").isNull()
    return {
        "ALLELIC": F.when(haploid, x).otherwise(x + y), "ALLELIC2": F.when(haploid, 2 * x).otherwise(x + y), "ALLELIC3": F.when(haploid, 1 + x).otherwise(x + y),
        "DOM": F.when(haploid, x).otherwise(F.greatest(x, y)), "REC": F.when(haploid, 0).otherwise(x * y), "REC2": F.when(haploid, x).otherwise(x * y), "NULL": F.lit(0),
    }


def scored(genotypes: DataFrame, model: str) -> DataFrame:
    """genotypes (a1, a2, ...) with their score; a1 null is missing. DOSAGE and PROB_REF, PROB_HET, PROB_HOM score a stored field."""
    fields = {"DOSAGE": "dosage", "PROB_REF": "p0", "PROB_HET": "p1", "PROB_HOM": "p2"}
    value = F.col(fields[model]) if model in fields else models()[model]
    called = F.lit(True) if model in fields else F.col("a1").isNotNull()
    return genotypes.withColumn("score", F.when(F.coalesce(called, F.lit(False)), F.coalesce(value, F.lit(0))).otherwise(0))


def fixed_xy(genotypes: DataFrame, codes: dict[int, str], regions: list[tuple[int, int, int]], male: int = 1, female: int = 0) -> DataFrame:
    """genotypes (chr, bp1, sex, a1, a2, ...) as sex allows.

    codes names chromosomes X, Y or haploid; regions (chr, bp1, bp2) are pseudo-autosomal. On X all but females, on Y
    males and on haploid ones everyone has one allele: of two equal ones one stays, of different ones none. On Y
    others have no genotype.
    """
    on = lambda kind: F.col("chr").isin([c for c, k in codes.items() if k == kind] or [-1])
    shared = F.lit(False)
    for c, low, high in regions:
        shared = shared | ((F.col("chr") == c) & F.col("bp1").between(low, high))
    is_male, is_female = F.coalesce(F.col("sex") == male, F.lit(False)), F.coalesce(F.col("sex") == female, F.lit(False))
    gone = on("Y") & ~is_male
    single = on("haploid") | (on("X") & ~is_female & ~shared) | (on("Y") & is_male & ~shared)
    equal = F.col("a2").isNull() | (F.col("a1") == F.col("a2"))
    a1 = F.when(~gone & (~single | equal), F.col("a1"))
    return genotypes.withColumns({"a1": a1, "a2": F.when(~gone & ~single, F.col("a2"))})


def hard_called(genotypes: DataFrame, field: str, within: float) -> DataFrame:
    """genotypes with ac from a dosage that lies within a distance of 0, 1 or 2, else null; and from posteriors p0, p1, p2 that reach `within`."""
    if field == "posterior":
        most = F.greatest("p0", "p1", "p2")
        call = F.when(F.col("p0") == most, 0).when(F.col("p1") == most, 1).otherwise(2)
        return genotypes.withColumn("ac", F.when(most >= within, call))
    d = F.col(field)
    return genotypes.withColumn("ac", F.when(d <= within, 0).when(F.abs(d - 1) <= within, 1).when(d >= 2 - within, 2))


def imputation_quality(genotypes: DataFrame, key: str = "var_id") -> DataFrame:
    """(key, n, aaf, rsq): the variance of expected ALT counts against that of Hardy and Weinberg's genotypes at their frequency.

    genotypes have a `dosage` (0 to 2), or posteriors p0, p1, p2; those without any don't count. rsq is 0 where all
    have the same homozygote. Variance and mean come from one pass.
    """
    count = F.col("dosage") if "dosage" in genotypes.columns else F.col("p1") + 2 * F.col("p2")
    half = genotypes.select(key, (count / 2).alias("t")).where("t is not null")
    sums = half.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("aaf"), F.var_pop("t").alias("v"))
    expected = F.col("aaf") * (1 - F.col("aaf"))
    return sums.select(key, "n", "aaf", F.when(expected > 0, 2 * F.col("v") / expected).otherwise(0.0).alias("rsq"))


def em_frequencies(likelihoods: DataFrame, rounds: int = 10, close: float = 1e-4) -> DataFrame:
    """(var_id, n, f): the ALT frequency under Hardy-Weinberg by expectation and maximisation of genotype likelihoods.

    likelihoods: (var_id, indiv_id, l0, l1, l2). People with equal likelihoods are one weighted cell, so a variant holds
    as many cells as there are different triples, however many people it has; the rounds run on that array.
    """
    cells = likelihoods.groupBy("var_id", "l0", "l1", "l2").agg(F.count(F.lit(1)).alias("w"))
    whole = cells.groupBy("var_id").agg(F.sum("w").alias("n"), F.array_sort(F.collect_list(F.struct("l0", "l1", "l2", "w"))).alias("cells"))

    def better(f: Column) -> Column:
        def alts(c: Column) -> Column:
            p0, p1, p2 = c["l0"] * (1 - f) * (1 - f), c["l1"] * 2 * f * (1 - f), c["l2"] * f * f
            return c["w"] * (p1 + 2 * p2) / (p0 + p1 + p2)

        return F.aggregate("cells", F.lit(0.0), lambda s, c: s + alts(c)) / (2 * F.col("n"))

    def step(state: Column, _: Column) -> Column:
        new = F.when(state["done"], state["f"]).otherwise(better(state["f"]))
        return F.struct(new.alias("f"), (state["done"] | (F.abs(new - state["f"]) < close) | (new <= 0) | (new >= 1)).alias("done"))

    start = F.struct((1.0 / (2.0 * F.col("n"))).alias("f"), F.lit(False).alias("done"))
    return whole.select("var_id", "n", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["f"].alias("f"))


def em_called(likelihoods: DataFrame, least: float, rounds: int = 10) -> DataFrame:
    """(var_id, indiv_id, p0, p1, p2, dosage, ac): posteriors by the estimated frequency; the best genotype if it reaches `least`."""
    f = F.col("f")
    both = likelihoods.join(em_frequencies(likelihoods, rounds), "var_id")
    q0, q1, q2 = F.col("l0") * (1 - f) * (1 - f), F.col("l1") * 2 * f * (1 - f), F.col("l2") * f * f
    post = both.select("var_id", "indiv_id", *[(q / (q0 + q1 + q2)).alias(f"p{k}") for k, q in enumerate((q0, q1, q2))])
    return hard_called(post.withColumn("dosage", F.col("p1") + 2 * F.col("p2")), "posterior", least)
