"""Association of variants and genes with a disease or a quantitative trait."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_2x2, chi2_p, chi2_tail, fisher_2x2, normal_p, odds_ratio
from ..functions.tails import chi2_quantile, weighted_chi2_tail
from ..plans.study import Study, counted, people, ranked
from .intervals import points_in
from .replicates import labelled, ordered, pieces, summed, unpacked, whole_keys

#: People whose genotypes at a locus are one matrix in skat.
BLOCK_PEOPLE = 1024


def v_assoc(study: Study) -> DataFrame:
    """Allelic, dominant and recessive 2 x 2 tests of each biallelic variant: chi-square, exact p and odds ratio."""
    v = counted(study)
    a = {k: F.col(f"a_{k}") for k in ("rr", "het", "hom", "ac", "tot")}
    u = {k: F.col(f"u_{k}") for k in ("rr", "het", "hom", "ac", "tot")}
    tables = {
        "": (a["ac"], a["tot"] - a["ac"], u["ac"], u["tot"] - u["ac"]),
        "dom": (a["het"] + a["hom"], a["rr"], u["het"] + u["hom"], u["rr"]),
        "rec": (a["hom"], a["rr"] + a["het"], u["hom"], u["rr"] + u["het"]),
    }
    out = [f(*t).alias(f"{name}{tag}") for tag, t in tables.items() for name, f in (("chi2", chi2_2x2), ("p", fisher_2x2), ("or", odds_ratio))]
    return v.select("var_id", "maf", F.col("a_rr").alias("refa"), F.col("a_het").alias("heta"), F.col("a_hom").alias("homa"), F.col("u_rr").alias("refu"), F.col("u_het").alias("hetu"), F.col("u_hom").alias("homu"), *out)


def glm_linear(study: Study) -> DataFrame:
    """Regression of the trait on the ALT count: n, slope, standard error and t.

    People without a row are reference homozygotes; their sums follow from those of all people.
    """
    g = study.geno.join(study.indiv.select("indiv_id", "qt"), "indiv_id").where("qt is not null")
    x, y = F.col("ac").cast("double"), F.col("qt")
    called, lost = F.col("ac").isNotNull(), F.col("ac").isNull()
    part = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    sums = g.groupBy("var_id").agg(part(called, x).alias("sx"), part(called, x * x).alias("sxx"), part(called, x * y).alias("sxy"), part(lost, F.lit(1.0)).alias("ln"), part(lost, y).alias("ly"), part(lost, y * y).alias("lyy"))
    every = study.indiv.agg(F.count("qt").cast("double").alias("tn"), F.sum("qt").alias("ty"), F.sum(y * y).alias("tyy"))
    v = sums.crossJoin(F.broadcast(every))  # one row
    n, sy, syy = F.col("tn") - F.col("ln"), F.col("ty") - F.col("ly"), F.col("tyy") - F.col("lyy")
    cxx, cxy, cyy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("sxy") - F.col("sx") * sy / n, syy - sy**2 / n
    v = v.select("var_id", n.cast("long").alias("n"), cxx.alias("cxx"), cxy.alias("cxy"), cyy.alias("cyy")).where("cxx > 1e-9 and n > 2").withColumn("beta", F.col("cxy") / F.col("cxx"))
    se = F.sqrt((F.col("cyy") - F.col("beta") * F.col("cxy")) / (F.col("n") - 2) / F.col("cxx"))
    return v.select("var_id", "n", "beta", se.alias("se"), (F.col("beta") / se).alias("stat"))


def glm_robust(study: Study, level: float = 1.959963984540054) -> DataFrame:
    """(var_id, n, beta, se, robust, low, high, p): glm_linear with Huber and White's standard error, and beta's interval of plus and minus `level` of it.

    Carriers are read once more with their variant's fit; all others have no ALT allele, so their squared residuals
    follow from sums of the trait.
    """
    fit = glm_linear(study).select("var_id", "n", "beta", "se")
    y = F.col("qt")
    g = study.geno.join(study.indiv.select("indiv_id", "qt"), "indiv_id").where("qt is not null")
    part = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    called = F.col("ac").isNotNull()
    sums = g.groupBy("var_id").agg(part(called, F.col("ac").cast("double")).alias("sx"), part(called, y).alias("gy"), F.count("ac").alias("gn"), F.sum(y).alias("ay"), F.sum(y * y).alias("ayy"), F.count(F.lit(1)).alias("an"))
    every = study.indiv.agg(F.count("qt").cast("double").alias("tn"), F.sum("qt").alias("ty"), F.sum(y * y).alias("tyy"))
    model = fit.join(sums, "var_id").crossJoin(F.broadcast(every))  # one row
    n, rn, ry, ryy = F.col("n"), F.col("tn") - F.col("an"), F.col("ty") - F.col("ay"), F.col("tyy") - F.col("ayy")
    my = (ry + F.col("gy")) / n
    model = model.withColumn("mx", F.col("sx") / n).withColumn("my", my).withColumn("shift", F.col("my") - F.col("beta") * F.col("mx"))
    # Those without an ALT allele: (0 - mx)**2 * (y - shift)**2, summed.
    rest = F.col("mx") ** 2 * (ryy - 2 * F.col("shift") * ry + rn * F.col("shift") ** 2)
    model = model.withColumn("rest", rest).select("var_id", "n", "beta", "se", "mx", "shift", "rest")
    own = g.where("ac is not null").select("var_id", "ac", "qt").join(model.select("var_id", "beta", "mx", "shift"), "var_id")
    x = F.col("ac") - F.col("mx")
    meat = own.groupBy("var_id").agg(F.sum(x**2 * (F.col("qt") - F.col("shift") - F.col("beta") * F.col("ac")) ** 2).alias("meat"), F.sum(F.col("ac").cast("double") ** 2).alias("sxx"))
    out = model.join(meat, "var_id").withColumn("robust", F.sqrt(F.col("meat") + F.col("rest")) / (F.col("sxx") - n * F.col("mx") ** 2))
    out = out.withColumn("z", F.col("beta") / F.col("robust"))
    return out.select("var_id", "n", "beta", "se", "robust", (F.col("beta") - level * F.col("robust")).alias("low"), (F.col("beta") + level * F.col("robust")).alias("high"), normal_p("z").alias("p"))


def residuals(study: Study, covariates: tuple[str, ...] = ("sex",)) -> DataFrame:
    """(indiv_id, residual): the trait less what its covariates explain, by least squares.

    One row of sums reaches the driver, which solves for the slopes; the table itself stays where it is. People without trait or a
    covariate have none. A covariate that follows from those before it adds nothing.
    """
    names = [*covariates, "qt"]
    full = study.indiv.select("indiv_id", *[F.col(c).cast("double").alias(f"t{k}") for k, c in enumerate(names)]).dropna()
    m = len(covariates)
    means = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"t{k}").alias(f"m{k}") for k in range(m + 1)]).first()
    if not means["n"]:
        return full.select("indiv_id", F.lit(None).cast("double").alias("residual"))
    z = [F.col(f"t{k}") - F.lit(means[f"m{k}"]) for k in range(m + 1)]
    sums = full.agg(F.lit(0.0).alias("none"), *[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m + 1)]).first()
    a, b = np.zeros((m, m)), np.zeros(m)
    for i in range(m):
        b[i] = sums[f"a{i}_{m}"]
        for j in range(i, m):
            a[i, j] = a[j, i] = sums[f"a{i}_{j}"]
    slopes = np.linalg.lstsq(a, b, rcond=1e-10)[0] if m else b
    explained = sum((F.lit(float(c)) * z[k] for k, c in enumerate(slopes)), F.lit(0.0))
    return full.select("indiv_id", (z[m] - explained).alias("residual"))


def regression(x: np.ndarray, y: np.ndarray, logistic: bool, steps: int = 20, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and standard errors of least squares or logistic regression; None where it doesn't settle. w: how often a row stands."""
    w = np.ones(len(y)) if w is None else w
    try:
        if not logistic:
            inverse = np.linalg.inv((x * w[:, None]).T @ x)
            b = inverse @ x.T @ (w * y)
            r = y - x @ b
            return b, np.sqrt(np.diag(inverse) * (w * r @ r) / (w.sum() - x.shape[1]))
        b = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = np.linalg.inv((x * (w * p * (1 - p))[:, None]).T @ x)
            step = h @ x.T @ (w * (y - p))
            b = b + step
            if np.abs(step).max() < 1e-6:
                return b, np.sqrt(np.diag(h))
    except np.linalg.LinAlgError:
        pass
    return None


def regressions(x: np.ndarray, y: np.ndarray, w: np.ndarray, fitted: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the second column and its standard error by logistic regression, for each row of weights w; nan where it isn't fitted or doesn't settle."""
    found, se = np.full(len(w), np.nan), np.full(len(w), np.nan)
    open_, b = np.flatnonzero(fitted), np.zeros((int(fitted.sum()), x.shape[1]))
    for _ in range(steps):
        if not len(open_):
            break
        p = 1 / (1 + np.exp(-np.clip(b @ x.T, -30, 30)))
        h = np.einsum("vn,ni,nj->vij", w[open_] * p * (1 - p), x, x, optimize=True)
        try:
            inverse, good = np.linalg.inv(h), np.ones(len(h), bool)
        except np.linalg.LinAlgError:
            inverse, good = np.zeros_like(h), np.ones(len(h), bool)
            for k in range(len(h)):
                try:
                    inverse[k] = np.linalg.inv(h[k])
                except np.linalg.LinAlgError:
                    good[k] = False
        step = np.einsum("vij,vj->vi", inverse, (w[open_] * (y - p)) @ x)
        b = b + step
        done = good & (np.abs(step).max(1) < 1e-6)
        found[open_[done]] = b[done, 1]
        with np.errstate(invalid="ignore"):
            se[open_[done]] = np.sqrt(inverse[done, 1, 1])
        open_, b = open_[good & ~done], b[good & ~done]
    return found, se


#: Variance inflation above which a variant isn't fitted.
MOST_INFLATION = 50.0


def inflation(spread: np.ndarray) -> float:
    """The largest variance inflation factor of variables with this covariance; infinite where one follows from others."""
    sd = np.sqrt(np.diag(spread))
    if not (sd > 0).all():
        return float("inf")
    try:
        return float(np.diag(np.linalg.inv(spread / np.outer(sd, sd))).max())
    except np.linalg.LinAlgError:
        return float("inf")


def _glm_sums(study: Study, covariates: tuple[str, ...]) -> DataFrame:
    """Least squares of the trait on ALT count and covariates from sums: those of all people less those of missing genotypes.

    vif is the largest variance inflation; a variant above MOST_INFLATION isn't fitted.

    People without trait or covariates are left out. Trait and covariates are taken from their means, which
    changes no slope and keeps the sums small.
    """
    names = [*covariates, "qt"]
    full = study.indiv.select("indiv_id", *[F.col(c).cast("double").alias(f"t{k}") for k, c in enumerate(names)]).dropna()
    means = full.agg(*[F.avg(f"t{k}").alias(f"m{k}") for k in range(len(names))])
    full = full.crossJoin(F.broadcast(means)).select("indiv_id", F.lit(1.0).alias("z0"), *[(F.col(f"t{k}") - F.col(f"m{k}")).alias(f"z{k + 1}") for k in range(len(names))])  # one row
    m = len(names) + 1
    crossed = [(i, j) for i in range(m) for j in range(i, m)]
    total = full.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"a{i}_{j}") for i, j in crossed])
    g = study.geno.join(full, "indiv_id")
    lost = [F.coalesce(F.sum(F.when(F.col("ac").isNull(), F.col(f"z{i}") * F.col(f"z{j}"))), F.lit(0.0)).alias(f"l{i}_{j}") for i, j in crossed]
    held = [F.coalesce(F.sum(F.col("ac") * F.col(f"z{i}")), F.lit(0.0)).alias(f"h{i}") for i in range(m)]
    sums = g.groupBy("var_id").agg(*lost, *held, F.coalesce(F.sum((F.col("ac") * F.col("ac")).cast("double")), F.lit(0.0)).alias("hh")).crossJoin(F.broadcast(total))  # one row

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                whole = np.zeros((m + 1, m + 1))  # 1, covariates, trait, ALT count
                for i, j in crossed:
                    whole[i, j] = whole[j, i] = r[f"a{i}_{j}"] - r[f"l{i}_{j}"]
                whole[m, :m] = whole[:m, m] = [r[f"h{i}"] for i in range(m)]
                whole[m, m] = r["hh"]
                n, at = whole[0, 0], [0, m, *range(1, m - 1)]
                found, own = None, whole[np.ix_(at[1:], at[1:])] - np.outer(whole[0, at[1:]], whole[0, at[1:]]) / max(n, 1)
                vif = inflation(own)
                if vif <= MOST_INFLATION and n > len(at) and whole[m, m] - whole[0, m] ** 2 / n > 1e-9:
                    try:
                        inverse, right = np.linalg.inv(whole[np.ix_(at, at)]), whole[at, m - 1]
                        slopes = inverse @ right
                        found = slopes[1], np.sqrt(inverse[1, 1] * max(whole[m - 1, m - 1] - right @ slopes, 0.0) / (n - len(at)))
                    except np.linalg.LinAlgError:
                        pass
                out.append((r["var_id"], int(n), *((*found, found[0] / found[1] if found[1] > 0 else None) if found else (None, None, None)), vif))
            yield pd.DataFrame(out, columns=["var_id", "n", "beta", "se", "stat", "vif"])

    return sums.mapInPandas(fit, "var_id long, n long, beta double, se double, stat double, vif double").withColumn("p", normal_p("stat"))


def glm(study: Study, covariates: tuple[str, ...] = ("sex",), logistic: bool = True) -> DataFrame:
    """Regression of disease (or trait) on ALT count and covariates, a row for each variant.

    A variant's task gets its stored genotypes only. The people are sent with the task as grouped counts:
    those with equal phenotype and covariates are one row with a weight, so the table is bounded by
    their combinations; quantitative covariates belong in the linear model, which needs sums only, or in strata.
    """
    if not logistic:
        return _glm_sums(study, covariates)
    y = (F.col("aff") - 1).cast("double")
    person = F.struct(y.alias("y"), *[F.col(c).cast("double").alias(c) for c in covariates])
    whole = study.indiv.groupBy(person.alias("k")).agg(F.count(F.lit(1)).alias("w")).select("k.*", "w").toPandas()
    g = study.geno.join(study.indiv.select("indiv_id", y.alias("y"), *[F.col(c).cast("double").alias(c) for c in covariates]), "indiv_id")
    cells = g.groupBy("var_id", "y", *covariates, F.coalesce("ac", F.lit(-1)).alias("ac")).agg(F.count(F.lit(1)).alias("w"))
    names = ["y", *covariates]

    kinds = whole.assign(kind=np.arange(len(whole)))
    base = np.column_stack([np.ones(len(whole)), *[whole[c] for c in covariates]]).astype(float)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches, "var_id"):
            pdf = pdf.merge(kinds[[*names, "kind"]], on=names)
            ids, at = np.unique(pdf["var_id"].to_numpy(), return_inverse=True)
            levels = np.unique(np.r_[0, pdf["ac"].to_numpy()[pdf["ac"].to_numpy() >= 0]])
            w = np.zeros((len(ids), len(levels), len(whole)))
            w[:, 0] = whole["w"]
            np.subtract.at(w, (at, 0, pdf["kind"].to_numpy()), pdf["w"].to_numpy(float))
            seen = (pdf["ac"] >= 0).to_numpy()
            np.add.at(w, (at[seen], np.searchsorted(levels, pdf["ac"].to_numpy()[seen]), pdf["kind"].to_numpy()[seen]), pdf["w"].to_numpy(float)[seen])
            x = np.concatenate([np.column_stack([base[:, 0], np.full(len(base), float(k)), base[:, 1:]]) for k in levels])
            y = np.tile(whole["y"].to_numpy(float), len(levels))
            b, se = regressions(x, y, w.reshape(len(ids), -1), (w.sum(2) > 0).sum(1) > 1)
            yield pd.DataFrame({"var_id": ids, "n": w.sum((1, 2)).astype(int), "beta": b, "se": se, "stat": b / se})

    fitted = ordered(cells, "var_id").mapInPandas(fit, "var_id long, n long, beta double, se double, stat double")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return fitted.select("var_id", "n", *map(known, ("beta", "se", "stat"))).withColumn("p", normal_p("stat"))


def carriers(study: Study) -> DataFrame:
    """(loc_id, var_id, bp1, indiv_id, ac, aff): ALT genotypes at the variants of each locus."""
    v = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select(F.col("i_loc_id").alias("loc_id"), "var_id", "bp1")
    return study.geno.where("ac > 0").join(v, "var_id").join(study.indiv.select("indiv_id", "aff"), "indiv_id")


def gene_tests(study: Study) -> DataFrame:
    """By locus: SUMSTAT, BURDEN, UNIQ, MHIT, FRQWGT, VT and CALPHA statistics of ALT carriers.

    A person's burden is the number of ALT alleles; VT takes the largest standardised difference over thresholds
    of allele count; CALPHA compares the spread of case counts with a binomial one.
    """
    g = carriers(study)
    n = F.broadcast(people(study.indiv))  # one row
    case = F.col("aff") == 2
    each = g.groupBy("loc_id", "var_id").agg(F.sum("ac").alias("k"), F.sum(F.when(case, F.col("ac")).otherwise(0)).alias("ka"), F.count(F.when(case, 1)).alias("ca"), F.count(F.when(~case, 1)).alias("cu")).crossJoin(n)
    share = F.col("na") / F.col("n")
    f = (1 + F.col("k")) / (2 + F.col("n"))
    spread = F.col("k") * share * (1 - share)
    # Variance of (y - kp)² for a binomial y.
    around = F.col("k") * share * (1 - share) * (1 + (2 * F.col("k") - 6) * share * (1 - share)) - F.pow(spread, 2) + 0.0
    by_var = each.groupBy("loc_id").agg(
        F.count(F.lit(1)).alias("nvar"), F.sum(chi2_2x2(F.col("ca"), F.col("na") - F.col("ca"), F.col("cu"), F.col("nu") - F.col("cu"))).alias("sumstat"),
        F.count(F.when((F.col("ca") > 0) & (F.col("cu") == 0), 1)).alias("uniq_a"), F.count(F.when((F.col("cu") > 0) & (F.col("ca") == 0), 1)).alias("uniq_u"),
        F.sum((F.col("ka") - share * F.col("k")) / F.sqrt(f * (1 - f))).alias("frqwgt"),
        F.sum(F.pow(F.col("ka") - F.col("k") * share, 2) - spread).alias("_t"), F.sum(around).alias("_v"))
    steps = each.groupBy("loc_id", "k").agg(F.sum("ka").alias("ka"), F.sum("k").alias("s"), F.sum(F.pow("k", F.lit(2))).alias("s2"), F.first(share).alias("share"))
    upto = Window.partitionBy("loc_id").orderBy("k")
    vt = steps.select("loc_id", ((F.sum("ka").over(upto) - F.col("share") * F.sum("s").over(upto)) / F.sqrt(F.sum("s2").over(upto))).alias("z")).groupBy("loc_id").agg(F.max("z").alias("vt"))
    person = g.groupBy("loc_id", "indiv_id", "aff").agg(F.sum("ac").cast("double").alias("b"), F.count(F.lit(1)).alias("hits"))
    b = person.groupBy("loc_id").agg(F.sum(F.when(case, F.col("b")).otherwise(0.0)).alias("sa"), F.sum(F.when(case, F.col("b") ** 2).otherwise(0.0)).alias("qa"), F.sum(F.when(~case, F.col("b")).otherwise(0.0)).alias("su"), F.sum(F.when(~case, F.col("b") ** 2).otherwise(0.0)).alias("qu"),
        (F.count(F.when(case & (F.col("hits") > 1), 1)) - F.count(F.when(~case & (F.col("hits") > 1), 1))).alias("mhit")).crossJoin(n)
    ma, mu = F.col("sa") / F.col("na"), F.col("su") / F.col("nu")
    se = F.sqrt((F.col("qa") / F.col("na") - ma**2) / F.col("na") + (F.col("qu") / F.col("nu") - mu**2) / F.col("nu"))
    burden = b.select("loc_id", F.when(ma > mu, (ma - mu) / se).otherwise(0.0).alias("burden"), "mhit")
    return by_var.join(burden, "loc_id").join(vt, "loc_id").select("loc_id", "nvar", "sumstat", "burden", "uniq_a", "uniq_u", "mhit", "frqwgt", "vt", F.when(F.col("_v") > 0, F.col("_t") / F.sqrt("_v")).alias("calpha"))


def permuted(study: Study, replicates: int = 99, seed: int = 1, strata: bool = True) -> DataFrame:
    """(loc_id, p, ties): one-sided permutation p of the burden in cases, labels permuted within strata.

    A person's labels are bits; a variant's ALT alleles of cases are summed for all replicates at once, then those of a
    locus's variants. p is (as large or larger + 1) / (replicates + 1). Each locus with a variant has a row; where no carrier
    is a case, in the data or in a replicate, the burden is 0.
    """
    met = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select(F.col("i_loc_id").alias("loc_id"), "var_id")
    carried = study.geno.where("ac > 0").join(labelled(ranked(study, strata, True), replicates, seed - 1), "indiv_id").select("var_id", "ac", "labels")

    def alleles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sums in summed(batches, "var_id", lambda pdf: unpacked(pdf["labels"], replicates) * pdf["ac"].to_numpy(np.uint8)[:, None]):
            yield pd.DataFrame({"var_id": keys, "t": list(sums.astype(np.int32))})

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(replicates + 1, np.int32)
        for keys, sums in summed(batches, "loc_id", lambda pdf: np.stack([none if x is None else x for x in pdf["t"]])):
            yield pd.DataFrame({"loc_id": keys, "r": (sums[:, 1:] >= sums[:, :1]).sum(1), "ties": (sums[:, 1:] == sums[:, :1]).sum(1)})

    by_variant = ordered(carried, "var_id").mapInPandas(alleles, "var_id long, t array<int>")
    found = ordered(met.join(by_variant, "var_id", "left").select("loc_id", "t"), "loc_id").mapInPandas(reached, "loc_id long, r long, ties long")
    return found.select("loc_id", ((F.col("r") + 1) / F.lit(float(replicates + 1))).alias("p"), "ties")


def liu_tail(q: float, eigen: np.ndarray) -> float:
    """Upper tail of a weighted sum of central chi-squares by matching moments.

    The square of the skewness never exceeds the kurtosis of such a sum, so the matching chi-square is central, too.
    """
    c = [float((eigen**k).sum()) for k in (1, 2, 3, 4)]
    df = c[1] ** 2 / c[3]  # any real number
    z = (q - c[0]) / np.sqrt(2 * c[1])
    return chi2_tail(max(df + z * np.sqrt(2 * df), 0.0), df)


class Products:
    """A locus's variants (ids, at bp): products of ALT counts summed over people (xx), ALT counts of all (s) and of cases (c), with labels (people x replicates) for each replicate."""

    def __init__(self):
        self.ids = np.zeros(0, np.int64)

    def add(self, rows: dict[str, np.ndarray], block: int) -> None:
        """More people's rows, in order of people; `block` of them are a matrix at a time."""
        who = np.cumsum(np.r_[True, rows["indiv_id"][1:] != rows["indiv_id"][:-1]]) - 1
        ids, at, col = np.unique(rows["var_id"], return_index=True, return_inverse=True)
        first, m, reps = np.flatnonzero(np.r_[True, np.diff(who) > 0]), len(ids), rows["labels"].shape[1]
        xx, s, c, xc = np.zeros((m, m)), np.zeros(m), np.zeros((reps, m)), np.zeros((reps, m, m) if reps > 1 else 0)
        for a in range(0, int(who[-1]) + 1, block):
            own = slice(first[a], first[a + block] if a + block < len(first) else len(who))
            x = np.zeros((min(block, len(first) - a), m))
            x[who[own] - a, col[own]] = rows["ac"][own]
            case = rows["labels"][first[a : a + block]].T.astype(float)
            xx += x.T @ x
            s += x.sum(0)
            c += case @ x
            if reps > 1:
                # Most carry one variant; of two and more the products are few people's.
                several = (x > 0).sum(1) > 1
                xc[:, np.arange(m), np.arange(m)] += case[:, ~several] @ x[~several] ** 2
                xc += np.einsum("rp,pi,pj->rij", case[:, several], x[several], x[several], optimize=True)
        self.merge(ids, rows["bp1"][at], xx, s, c, xc)

    def merge(self, ids, bp, xx, s, c, xc) -> None:
        if not len(self.ids):
            self.ids, self.bp, self.xx, self.s, self.c, self.xc = ids, bp, xx, s, c, xc
            return
        every, first = np.unique(np.r_[self.ids, ids], return_index=True)
        self.bp = np.r_[self.bp, bp][first]
        new = [np.zeros((len(every),) * 2), np.zeros(len(every)), np.zeros((len(c), len(every))), np.zeros((len(c), len(every), len(every)) if len(c) > 1 else 0)]
        for i, part in ((np.searchsorted(every, self.ids), (self.xx, self.s, self.c, self.xc)), (np.searchsorted(every, ids), (xx, s, c, xc))):
            new[0][np.ix_(i, i)] += part[0]
            new[1][i] += part[1]
            new[2][:, i] += part[2]
            if len(c) > 1:
                new[3][:, i[:, None], i[None, :]] += part[3]
        self.ids, (self.xx, self.s, self.c, self.xc) = every, new


def by_locus(study: Study, fit: Callable[[int, Products], tuple], schema: str, block: int = BLOCK_PEOPLE, labels: DataFrame | None = None, replicates: int = 0) -> DataFrame:
    """A row of `fit` for each locus with a carrier, from the products of its variants.

    A task reads the carriers of its loci in order of people and multiplies `block` people at a time, so none holds a locus's
    whole people x variants matrix. labels (indiv_id, labels) give the products in cases for each replicate.
    """
    g = carriers(study)
    columns = ["loc_id", "indiv_id", "var_id", "bp1", "ac", "aff"]
    drawn = labels is not None
    if drawn:
        g, columns = g.join(labels, "indiv_id"), [*columns, "labels"]

    def arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        case = (pdf["aff"] == 2).to_numpy()[:, None] if not drawn else unpacked(pdf["labels"], replicates)
        return {**{c: pdf[c].to_numpy() for c in ("loc_id", "indiv_id", "var_id", "bp1", "ac")}, "labels": case}

    names = [x.split()[0] for x in schema.split(", ")]

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = [], Products()
        for loc, rows, last in pieces(batches, "loc_id", "indiv_id", arrays):
            now.add(rows, block)
            if last:
                out.append(fit(int(loc), now))
                now = Products()
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return ordered(g.select(*columns), "loc_id", "indiv_id").mapInPandas(fitted, schema)


def sizes(study: Study) -> tuple[float, float]:
    """People and cases, as numbers: one row."""
    return tuple(map(float, people(study.indiv).select("n", "na").first()))


def kernel(of: Products, k: float, share: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray]:
    """A locus's scores and their covariance under the null, both with beta(MAF) weights, from its products of variants."""
    maf = of.s / (2 * k)
    w = a2 * (1 - maf) ** (a2 - 1) if a1 == 1 else maf ** (a1 - 1) * (1 - maf) ** (a2 - 1)
    return w * (of.c[0] - share * of.s), np.outer(w, w) * (of.xx - np.outer(of.s, of.s) / k) * share * (1 - share)


def eigenvalues(symmetric: np.ndarray) -> np.ndarray:
    """Those that count in a sum of chi-squares."""
    found = np.linalg.eigvalsh(symmetric)
    return found[found > max(found.mean(), 0) / 1e5]


def quadratic_tail(q: float, eigen: np.ndarray) -> float:
    """Upper tail of a weighted sum of chi-squares by inversion, or by moments where that doesn't settle."""
    if not len(eigen):
        return 1.0
    exact = weighted_chi2_tail(q, eigen)
    return liu_tail(q, eigen) if exact is None or exact[0] <= 0 else float(exact[0])


def skat(study: Study, a1: float = 1.0, a2: float = 25.0, block: int = BLOCK_PEOPLE) -> DataFrame:
    """(loc_id, nvar, q, p): kernel test with beta(MAF) weights of the disease residuals, without covariates.

    A locus is fitted from the products of its variants; people without one enter by the shared residual mean only.
    """
    n, na = sizes(study)

    def fit(loc: int, of: Products) -> tuple:
        score, spread = kernel(of, n, na / n, a1, a2)
        q = float((score**2).sum()) / 2
        return loc, len(score), q, quadratic_tail(q, eigenvalues(spread / 2))

    return by_locus(study, fit, "loc_id long, nvar long, q double, p double", block)


#: Weights of the burden against the kernel that SKAT-O tries; 1 would leave no kernel.
RHOS = np.array([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.999])


def optimal_p(score: np.ndarray, spread: np.ndarray, rhos: np.ndarray = RHOS) -> tuple[float, float, float]:
    """(rho, its p, p of the best): the kernel test with correlated effects, least p over rhos, against the distribution of that least p.

    For every rho the statistic is kappa * (1 - rho) + tau * chi-square(1) with the same kappa, a weighted sum of
    chi-squares from what the burden leaves over, and the chi-square of the burden; kappa's tail is integrated over it.
    """
    spread, score = spread / 2, score / np.sqrt(2)
    burden = spread.sum(1)
    total = burden.sum()
    if not total > 0:
        return 0.0, 1.0, 1.0
    p = np.ones(len(rhos))
    moments = np.zeros((len(rhos), 3))
    for i, rho in enumerate(rhos):
        root = np.sqrt(1 - rho) * np.eye(len(score)) + (np.sqrt(1 - rho + rho * len(score)) - np.sqrt(1 - rho)) / len(score)
        eigen = eigenvalues(root @ spread @ root)
        c = [(eigen**k).sum() for k in (1, 2, 4)]
        df = c[1] ** 2 / c[2]  # the chi-square of the same kurtosis
        moments[i] = c[0], np.sqrt(2 * c[1]), df
        q = (1 - rho) * (score**2).sum() + rho * score.sum() ** 2
        p[i] = chi2_tail(max((q - c[0]) / moments[i, 1] * np.sqrt(2 * df) + df, 0.0), df)
    best = int(p.argmin())
    if len(score) == 1 or p[best] >= 1:
        return float(rhos[best]), float(p[best]), float(p[best])
    limit = np.array([(chi2_quantile(p[best], df) - df) / np.sqrt(2 * df) * sd + mean for mean, sd, df in moments])
    left = spread - np.outer(burden, burden) / total
    weights = eigenvalues(left)
    tau = rhos * total + (1 - rhos) * (burden @ burden) / total
    extra = 4 * float(np.trace(np.outer(burden, burden) @ left)) / total  # of burden and rest together
    mean, plain = weights.sum(), 2 * (weights**2).sum()
    z, gauss = np.polynomial.legendre.leggauss(96)
    z, gauss = 3.5 * (z + 1), 3.5 * gauss  # a normal beyond 7 doesn't count
    delta = ((limit[:, None] - np.multiply.outer(tau, z**2)) / (1 - rhos)[:, None]).min(0)
    scaled = (delta - mean) * np.sqrt(plain / (plain + extra)) + mean if len(weights) else delta
    if not len(weights):
        over = (delta < 0).astype(float)
    else:
        over = weighted_chi2_tail(np.maximum(scaled, 0), weights)
        over = np.array([liu_tail(x, weights) for x in scaled]) if over is None else np.where(scaled <= 0, 1.0, over)
    whole = float((over * 2 * np.exp(-(z**2) / 2) / np.sqrt(2 * np.pi)) @ gauss)
    return float(rhos[best]), float(p[best]), min(max(whole, p[best]), 1.0, p[best] * len(rhos))


def skat_o(study: Study, a1: float = 1.0, a2: float = 25.0, block: int = BLOCK_PEOPLE) -> DataFrame:
    """(loc_id, nvar, rho, p_rho, p): the kernel test with the best weight of the burden, and p for having chosen it."""
    n, na = sizes(study)
    fit = lambda loc, of: (loc, len(of.ids), *optimal_p(*kernel(of, n, na / n, a1, a2)))
    return by_locus(study, fit, "loc_id long, nvar long, rho double, p_rho double, p double", block)


def gene_p(tests: DataFrame) -> DataFrame:
    """gene_tests with the chi-square p of SUMSTAT and the normal p of CALPHA."""
    return tests.withColumn("p_sumstat", chi2_p("sumstat", "nvar")).withColumn("p_calpha", normal_p("calpha"))
