"""Association over a network of loci: connected sets that grow while their statistic does, and its permutations.

All seeds of all replicates grow at once: a round joins each frontier to its loci's counts, keeps the best neighbour
of each seed and takes in that neighbour's own. A round's tables are cut from what made them by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_2x2, chi2_table
from ..plans.study import Study, people, ranked
from ..sources.scratch import kept, shared_folder
from .intervals import points_in
from .replicates import by_replicate, label_sums, labelled, ordered, summed, unpacked


def cut(df: DataFrame) -> DataFrame:
    """df from files in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def statistic(ca: Column, cu: Column) -> Column:
    """Chi-square of carriers against the totals na and nu; -1 without a carrier, none where a person who counts twice makes more than all."""
    a, b = F.col("na") - ca, F.col("nu") - cu
    return F.when((ca == 0) & (cu == 0), -1.0).when((a >= 0) & (b >= 0), chi2_2x2(ca, cu, a, b))


def grown(counts: DataFrame, edges: DataFrame, seeds: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed, rep, ca, cu, stat) when no neighbour helps any more, and what was taken in: (seed, rep, node, parent, depth).

    counts (node, rep, ca, cu), edges (a, b), seeds (seed), totals: one row na, nu. In a round a seed's candidates are tried
    in order; one that doesn't beat all before it is never tried again, the last that does is taken. Neighbours of the seed
    bring in their own neighbours.
    """
    keys = ["seed", "rep"]
    one = F.broadcast(totals)  # one row
    own = counts.withColumnRenamed("node", "seed").join(seeds, "seed", "left_semi").crossJoin(one)
    state = cut(own.select("seed", "rep", "ca", "cu", statistic(F.col("ca"), F.col("cu")).alias("stat"), "na", "nu"))
    near = edges.select(F.col("a").alias("seed"), F.col("b").alias("node")).where("seed <> node").distinct()
    frontier = cut(state.select(*keys).join(near, "seed").select(*keys, "node", F.lit(None).cast("long").alias("parent"), F.lit(1).alias("depth")))
    seen, taken = frontier.select(*keys, "node"), None
    while True:
        tried = frontier.join(counts.select("node", "rep", F.col("ca").alias("xa"), F.col("cu").alias("xu")), ["node", "rep"]).join(state, keys)
        tried = tried.withColumn("stat1", statistic(F.col("ca") + F.col("xa"), F.col("cu") + F.col("xu")))
        earlier = Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        better = tried.withColumn("bar", F.greatest("stat", F.max("stat1").over(earlier))).where("stat1 > bar")
        better = cut(better.withColumn("best", F.max("node").over(Window.partitionBy(*keys)) == F.col("node")))
        best = better.where("best")
        if best.limit(1).count() == 0:
            break
        new = best.select(*keys, "node", "parent", "depth")
        taken = new if taken is None else taken.union(new)
        moved = best.select(*keys, (F.col("ca") + F.col("xa")).alias("ca1"), (F.col("cu") + F.col("xu")).alias("cu1"), "stat1")
        state = cut(state.join(moved, keys, "left").select(*keys, F.coalesce("ca1", "ca").alias("ca"), F.coalesce("cu1", "cu").alias("cu"), F.coalesce("stat1", "stat").alias("stat"), "na", "nu"))
        more = new.where("depth = 1").join(near.select(F.col("seed").alias("node"), F.col("node").alias("next")), "node").where("next <> seed")
        more = more.select(*keys, F.col("next").alias("node"), F.col("node").alias("parent"), F.lit(2).alias("depth")).join(seen, [*keys, "node"], "left_anti")
        frontier = cut(better.where("not best").select(*keys, "node", "parent", "depth").union(more))
        seen = cut(seen.union(more.select(*keys, "node")))
        taken = cut(taken)
    nothing = frontier.where("false").select(*keys, "node", "parent", "depth")
    return state.select(*keys, "ca", "cu", "stat"), nothing if taken is None else taken


def _grown(study: Study, replicates: int, threshold: float, strata: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    met = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select(F.col("i_loc_id").alias("node"), "var_id")
    sizes = met.groupBy("node").agg(F.countDistinct("var_id").alias("nvar"))
    carried = study.geno.where("ac > 0").join(met, "var_id").select("node", "indiv_id").distinct().join(labelled(ranked(study, strata), replicates), "indiv_id")
    counts = kept(by_replicate(label_sums(carried, "node", replicates), "node"), "counts")
    has = sizes.select("node")
    edges = study.edges.where(F.col("score") >= threshold).join(has.withColumnRenamed("node", "a"), "a", "left_semi").join(has.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b").distinct()
    state, taken = grown(counts, edges, has.withColumnRenamed("node", "seed"), people(study.indiv).select("na", "nu"))
    return state, taken, sizes, counts


def net_assoc(study: Study, replicates: int = 99, threshold: float = 0.0, strata: bool = True) -> DataFrame:
    """(seed, links, size, nvar, ca, cu, chi2, p): each locus with the connected loci that raise its chi-square.

    A person counts once in each locus where they carry an ALT allele. p is (replicates whose own growth reaches as far
    + 1) / (replicates + 1), labels permuted within strata. Loci without a carrier have no row.
    """
    state, taken, sizes, _ = _grown(study, replicates, threshold, strata)
    real = state.where("rep = 0").select("seed", "ca", "cu", F.col("stat").alias("chi2"))
    reached = state.where("rep > 0").join(real.select("seed", "chi2"), "seed").groupBy("seed").agg(F.count(F.when(F.col("stat") >= F.col("chi2") - 1e-9, 1)).alias("more"))
    inside = taken.where("rep = 0").join(sizes, "node").groupBy("seed").agg(F.count(F.lit(1)).alias("k"), F.sum("nvar").alias("more_var"))
    degree = study.edges.where(F.col("score") >= threshold).where("a <> b").select("a", "b").distinct().join(sizes.select(F.col("node").alias("b")), "b").groupBy(F.col("a").alias("seed")).agg(F.count(F.lit(1)).alias("links"))
    out = real.join(reached, "seed", "left").join(inside, "seed", "left").join(degree, "seed", "left").join(sizes.withColumnRenamed("node", "seed"), "seed")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("seed", zero("links").alias("links"), (zero("k") + 1).alias("size"), (F.col("nvar") + zero("more_var")).alias("nvar"), "ca", "cu", "chi2", ((zero("more") + 1) / F.lit(replicates + 1.0)).alias("p"))


def net_partners(study: Study, threshold: float = 0.0) -> DataFrame:
    """(seed, node, parent, ca, cu): the loci that each seed took in, through which, with their own carriers."""
    _, taken, _, counts = _grown(study, 0, threshold, True)
    return taken.join(counts.where("rep = 0").select("node", "ca", "cu"), "node").select("seed", "node", "parent", "ca", "cu")


def v_assoc_permuted(study: Study, replicates: int = 99, strata: bool = True) -> DataFrame:
    """(var_id, chi2, p, chi2dom, pdom, chi2rec, prec): allelic, dominant and recessive chi-squares of each variant, with p from labels permuted within strata.

    p is (replicates that reach the statistic + 1) / (replicates + 1). A missing genotype takes its person out of the table,
    with whatever label the replicate gives. Variants without a stored genotype have no row.
    """
    na, nu = people(study.indiv).select("na", "nu").first()
    stored = study.geno.where("ac is null or ac > 0").join(labelled(ranked(study, strata), replicates), "indiv_id").select("var_id", "ac", "labels")

    def cells(pdf: pd.DataFrame) -> np.ndarray:
        """All and cases of each kind: one ALT allele, two, missing."""
        bits = np.concatenate([np.ones((len(pdf), 1), np.uint8), unpacked(pdf["labels"], replicates)], axis=1)
        ac = pdf["ac"].to_numpy(float)
        return np.concatenate([bits * k[:, None].astype(np.uint8) for k in (ac == 1, ac == 2, ~((ac == 1) | (ac == 2)))], axis=1)

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sums in summed(batches, "var_id", cells):
            three = sums.reshape(len(keys), 3, -1)
            ca, cu = three[:, :, 1:], three[:, :, :1] - three[:, :, 1:]
            (ra, ha, oa), (ru, hu, ou) = ((n - c.sum(1), c[:, 0], c[:, 1]) for n, c in ((na, ca), (nu, cu)))
            tables = {"": (ha + 2 * oa, 2 * ra + ha, hu + 2 * ou, 2 * ru + hu), "dom": (ha + oa, ra, hu + ou, ru), "rec": (oa, ra + ha, ou, ru + hu)}
            out = {"var_id": keys}
            for k, t in tables.items():
                found = chi2_table(*t)
                out |= {f"chi2{k}": found[:, 0], f"p{k}": ((found[:, 1:] >= found[:, :1] - 1e-9).sum(1) + 1) / (replicates + 1.0)}
            yield pd.DataFrame(out)

    return ordered(stored, "var_id").mapInPandas(tested, "var_id long, chi2 double, p double, chi2dom double, pdom double, chi2rec double, prec double")


def largest_p(replicates: DataFrame, keys: tuple[str, ...] = ("test",)) -> DataFrame:
    """(keys, set, stat, p, p_corrected): statistics (keys, set, rep, stat) of sets against their own replicates and against each replicate's largest over all sets.

    rep 0 is the data. Sets without a row in a replicate count as below. p is (replicates that reach the statistic + 1) / (replicates + 1).
    """
    real = replicates.where("rep = 0").select(*keys, "set", F.col("stat").alias("seen"))
    drawn = replicates.where("rep > 0")
    n = F.broadcast(drawn.agg(F.max("rep").alias("n")))  # one row
    own = real.join(drawn, [*keys, "set"], "left").groupBy(*keys, "set", "seen").agg(F.count(F.when(F.col("stat") >= F.col("seen"), 1)).alias("r"))
    top = drawn.groupBy(*keys, "rep").agg(F.max("stat").alias("top"))
    # Each set's rank among the replicates' largest: a window over both, not a pair of each set and replicate.
    both = top.select(*keys, F.col("top").alias("value"), F.lit(None).cast("long").alias("set"), F.lit(1).alias("k")).union(own.select(*keys, "seen", "set", F.lit(0)))
    reached = both.withColumn("c", F.sum("k").over(Window.partitionBy(*keys).orderBy(F.col("value").desc()))).where("set is not null").select(*keys, "set", "c")
    joined = own.join(reached, [*keys, "set"]).crossJoin(n)
    size = F.coalesce("n", F.lit(0)) + F.lit(1.0)
    return joined.select(*keys, "set", F.col("seen").alias("stat"), ((F.col("r") + 1) / size).alias("p"), ((F.col("c") + 1) / size).alias("p_corrected"))


def smp(study: Study, replicates: int = 99, strata: bool = True) -> DataFrame:
    """(test, set, stat, p, p_corrected) of two statistics of every locus: cases among its carriers, and their chi-square."""
    met = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select(F.col("i_loc_id").alias("set"), "var_id")
    carried = study.geno.where("ac > 0").join(met, "var_id").select("set", "indiv_id").distinct().join(labelled(ranked(study, strata), replicates), "indiv_id")
    counts = by_replicate(label_sums(carried, "set", replicates), "set").crossJoin(F.broadcast(people(study.indiv).select("na", "nu")))  # one row
    chi2 = statistic(F.col("ca"), F.col("cu"))
    both = F.explode(F.create_map(F.lit("cases"), F.col("ca").cast("double"), F.lit("chi2"), chi2)).alias("test", "stat")
    return largest_p(kept(counts.select("set", "rep", both), "replicates"))
