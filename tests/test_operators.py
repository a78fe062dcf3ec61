import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoforge.functions import alleles, stats
from genoforge.operators import association, family, intervals, loci
from genoforge.plans.mask import TERMS, mask
from genoforge.plans.study import Study


def test_statistics():
    assert stats.hwe_p(0, 0, 0) == 1 and stats.hwe_p(10, 0, 0) == pytest.approx(0.0069064, abs=1e-6)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and stats.chi2_tail(30, 10) == pytest.approx(0.000857, abs=1e-6)
    assert stats.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)


def test_columns(spark):
    rows = [("A", "G", 0.1), ("A", "AT", 1.05), ("AT", "A", 1.95), ("AC", "GT", 0.5), ("A", ".", -1.0), ("A", "A", 2.0)]
    df = spark.createDataFrame(rows, "ref string, alt string, d double")
    got = df.select(alleles.allele_type(F.col("ref"), F.col("alt")), alleles.hard_call(F.col("d"), 0.1), alleles.in_range(F.col("d"), "0.5:2")).collect()
    assert [r[0] for r in got] == ["substitution", "insertion", "deletion", "mnp", "unknown", "reference"]
    assert [r[1] for r in got] == [0, 1, 2, None, 0, 2] and [r[2] for r in got] == [False, True, True, True, False, True]
    t = spark.createDataFrame([(3, 1, 1, 3), (0, 5, 2, 3), (0, 0, 0, 0)], "a long, b long, c long, d long")
    got = t.select(stats.fisher_2x2("a", "b", "c", "d"), stats.chi2_2x2(*map(F.col, "abcd")), stats.odds_ratio(*map(F.col, "abcd"))).collect()
    assert got[0][0] == pytest.approx(0.485714, abs=1e-6) and got[0][1] == 2.0 and got[0][2] == 9.0 and got[2][1] == 0.0 and got[1][2] == pytest.approx(0.5 * 3.5 / (5.5 * 2.5))
    assert spark.range(1).select(loci.translated(F.lit("ATGGCNTAAG")), loci.reverse_complement(F.lit("AACG"))).first()[:] == ("MX*", "CGTT")


def test_intervals(spark):
    r = random.Random(2)
    make = lambda n, most: [(k, r.randint(1, 2), a, a + r.choice([0, 5, 300, most])) for k in range(n) for a in [r.randint(1, 400_000)]]
    a, b = make(60, 50_000), make(80, 3_000_000)
    schema = "id long, chr int, bp1 long, bp2 long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted((x.id, x.i_id) for x in intervals.points_in(da, db).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[2] <= y[3])
    got = sorted((x.a_id, x.b_id, x.intersection) for x in intervals.overlaps(da, db).collect())
    assert got == sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2]) + 1) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    bases = lambda rows: {(x[1], p) for x in rows for p in range(x[2], x[3] + 1)}
    small_a, small_b = [x for x in a if x[3] - x[2] < 1000], [x for x in a if x[3] - x[2] >= 300]
    got = intervals.subtracted(spark.createDataFrame(small_a, schema), spark.createDataFrame(small_b, schema)).collect()
    assert {(x.chr, p) for x in got for p in range(x.bp1, x.bp2 + 1)} == bases(small_a) - bases(small_b)
    assert sum(x.bp2 - x.bp1 + 1 for x in intervals.merged(da).collect()) == len(bases(a))


def tiny(spark):
    variants = spark.createDataFrame([(1, 1, 100, "rs1", "A", "G", 50.0, "PASS"), (2, 1, 150, ".", "A", "AT", 10.0, "q10"), (3, 2, 500, "rs3", "C", "T", 60.0, "PASS;x")], "var_id long, chr int, bp1 long, name string, ref string, alt string, qual double, filter string")
    indiv = spark.createDataFrame([(k, k % 2, 2 if k < 4 else 1, float(k), k % 2, None, None) for k in range(8)] + [(8, 0, 2, 3.0, 0, 0, 1)], "indiv_id long, sex int, aff int, qt double, strata int, pat long, mat long")
    calls = spark.createDataFrame([(1, 1, 0, 1, 10.0, False), (2, 1, 0, 1, 3.0, False), (1, 1, 1, 2, 9.0, False), (1, 2, 5, 1, 4.0, False), (2, 2, 5, 2, 8.0, False), (1, 3, 8, 1, 9.0, False), (1, 1, 8, 2, 9.0, False), (1, 3, 2, 1, 1.0, True)], "file_id int, var_id long, indiv_id long, ac int, dp double, is_null boolean")
    from genoforge.plans.study import consensus

    pheno = indiv.select("indiv_id", F.lit("aff").alias("pheno"), F.col("aff").cast("double").alias("value"))
    return Study(variants=variants, calls=calls, geno=consensus(calls), indiv=indiv, pheno=pheno)


def test_masks(spark):
    s = tiny(spark)
    ids = lambda **t: sorted(r.var_id for r in mask(s, {k.replace("_", "."): v for k, v in t.items()}).variants.collect())
    assert {(r.var_id, r.indiv_id): r.ac for r in s.geno.collect()}[2, 5] is None  # files disagree
    assert ids(indel=True) == [2] and ids(snp=True) == [1, 3] and ids(filter_req="PASS") == [1, 3] and ids(filter="x") == [3] and ids(novel_ex=True) == [1, 3]
    assert ids(null="1:9") == [2, 3] and ids(mac="5") == [1] and ids(reg=["chr1:90-110"], id=["rs3"]) == [1, 3] and ids(obs_nfile="2") == [1, 2]
    assert ids(filter_req="PASS", id="nothing") == [1, 3]  # a requirement that holds makes includes void
    assert ids(indiv=[8], aac="1") == [3] and ids(phe="aff:1", aac="0") == [1, 2, 3] and ids(limit=2) == [1, 2]
    assert {(r.var_id, r.indiv_id): r.ac for r in mask(s, {"geno": ["dp:ge:8"]}).geno.collect()} == {(1, 0): 1, (1, 1): 2, (2, 5): 2, (3, 8): 1, (1, 8): 2, (3, 2): None}
    assert all(r.ac is not None for r in mask(s, {"assume-ref": True}).geno.collect()) and len(TERMS) > 95
    assert mask(s, {"eval": {"q2": "qual * 2"}}).variants.first().q2 is not None
    segments = spark.createDataFrame([(1, 1, 90, 120)], "indiv_id long, chr int, bp1 long, bp2 long")
    assert {(r.var_id, r.indiv_id) for r in mask(s, {"seg": [segments]}).geno.where("ac is not null").collect()} == {(1, 1)}
    with pytest.raises(ValueError):
        mask(s, {"nonsense": 1})


def test_family(spark):
    r = family.denovo(tiny(spark)).collect()
    assert [(x.child, x.missing, x.non_mendelian, x.potential_denovo) for x in r] == [(8, 0, 1, 1)]
    calls = spark.createDataFrame([(1, 8, 90.0, 0.0), (1, 0, 80.0, 0.0), (1, 1, 0.0, 90.0), (2, 8, 70.0, 0.0), (2, 0, 0.0, 99.0), (2, 1, 0.0, 99.0)], "var_id long, indiv_id long, sq double, nq double")
    trios = spark.createDataFrame([(8, 0, 1)], "child long, pat long, mat long")
    assert family.cnv_denovo(calls, trios).first()[:] == (8, 2, 1, 0, 0, 0, 1)
    ibd = spark.createDataFrame([(0, 1, 1, 50, 200), (1, 0, 1, 300, 400)], "id1 long, id2 long, chr int, bp1 long, bp2 long")
    got = {(x.x, x.y): (x.nseg, x.overlap, x.len) for x in family.ibd_sharing(tiny(spark), ibd).where("var_id = 1").collect()}
    assert got[0, 1] == (2, 1, 151)


def test_logistic_regression(spark):
    r = np.random.default_rng(3)
    n = 400
    sex, ac = r.integers(0, 2, n), r.choice([0, 0, 1, 2], n)
    aff = (r.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.8 * ac + 0.3 * sex)))).astype(int) + 1
    indiv = spark.createDataFrame([(k, int(sex[k]), int(aff[k])) for k in range(n)], "indiv_id long, sex int, aff int")
    geno = spark.createDataFrame([(7, k, int(ac[k])) for k in range(n) if ac[k]], "var_id long, indiv_id long, ac int")
    study = tiny(spark).but(indiv=indiv, geno=geno)
    got = association.glm(study).first()
    b, se = association.regression(np.column_stack([np.ones(n), ac, sex]).astype(float), (aff - 1).astype(float), True)
    assert got.n == n and got.beta == pytest.approx(b[1], abs=1e-6) and got.se == pytest.approx(se[1], abs=1e-6) and got.p < 0.01


def test_liu_tail_keeps_the_degrees_of_freedom():
    eigen = np.array([1.0, 0.5, 0.2])
    draws = np.random.default_rng(1).chisquare(1, (400_000, 3)) @ eigen
    df = (eigen**2).sum() ** 2 / (eigen**4).sum()
    for q in (4.0, 7.0):
        x = df + (q - eigen.sum()) / np.sqrt(2 * (eigen**2).sum()) * np.sqrt(2 * df)
        matched = (np.random.default_rng(2).gamma(df / 2, 2, 1_000_000) > x).mean()
        assert association.liu_tail(q, eigen) == pytest.approx(matched, abs=1e-3)
        assert association.liu_tail(q, eigen) == pytest.approx((draws > q).mean(), rel=0.1)


def test_skat_in_blocks_and_linear_sums(spark):
    r = np.random.default_rng(6)
    n, m = 500, 4
    x = r.choice([0, 0, 0, 1, 2], (n, m))
    case, sex, age = r.integers(0, 2, n), r.integers(0, 2, n), r.random(n)
    qt = 1000 + x[:, 0] * 0.4 + age + r.normal(0, 1, n)
    indiv = spark.createDataFrame([(k, int(sex[k]), int(case[k]) + 1, float(qt[k]), float(age[k])) for k in range(n)], "indiv_id long, sex int, aff int, qt double, age double")
    variants = spark.createDataFrame([(v, 1, 10 + v) for v in range(m)], "var_id long, chr int, bp1 long")
    loci = spark.createDataFrame([(1, 1, 1, 100)], "loc_id long, chr int, bp1 long, bp2 long")
    rows = [(v, k, int(x[k, v])) for v in range(m) for k in range(n) if x[k, v]]
    study = tiny(spark).but(indiv=indiv, variants=variants, loci=loci, geno=spark.createDataFrame(rows, "var_id long, indiv_id long, ac int"))
    w = 25 * (1 - x.sum(0) / (2 * n)) ** 24
    share, c = case.mean(), (x - x.mean(0)) * w
    eigen = np.linalg.eigvalsh(c.T @ c * share * (1 - share) / 2)
    q = (((case - share) @ (x * w)) ** 2).sum() / 2
    drawn = (r.chisquare(1, (400_000, m)) @ eigen > q).mean()  # the tail itself, which moments miss by 0.02 here
    for block in (7, 1000):
        got = association.skat(study, block=block).first()
        assert got.nvar == m and got.q == pytest.approx(q) and got.p == pytest.approx(drawn, abs=4e-3)
    assert association.liu_tail(q, eigen) == pytest.approx(drawn, abs=0.04)
    lost = study.but(geno=spark.createDataFrame([*rows, (0, int(np.flatnonzero(x[:, 0] == 0)[0]), None)], "var_id long, indiv_id long, ac int"))
    keep = np.arange(n) != np.flatnonzero(x[:, 0] == 0)[0]
    got = association.glm(lost, ("sex", "age"), logistic=False).where("var_id = 0").first()
    b, se = association.regression(np.column_stack([np.ones(n), x[:, 0], sex, age]).astype(float)[keep], qt[keep], False)
    assert got.n == n - 1 and got.beta == pytest.approx(b[1], abs=1e-8) and got.se == pytest.approx(se[1], abs=1e-8)


def test_permuted_burden_of_every_locus(spark):
    indiv = spark.createDataFrame([(k, 2 if k < 3 else 1, 0) for k in range(300)], "indiv_id long, aff int, strata int")
    variants = spark.createDataFrame([(k, 1, 100 * k) for k in range(1, 5)], "var_id long, chr int, bp1 long")
    loci = spark.createDataFrame([(k, 1, 100 * k, 100 * k + 9) for k in range(1, 6)], "loc_id long, chr int, bp1 long, bp2 long")
    geno = spark.createDataFrame([(1, 200, 1), (2, 0, 2), (2, 1, 2), (2, 2, 2), (3, 0, 1), (3, 100, 1)], "var_id long, indiv_id long, ac int")
    got = {r.loc_id: r for r in association.permuted(tiny(spark).but(indiv=indiv, variants=variants, loci=loci, geno=geno), 19).collect()}
    assert set(got) == {1, 2, 3, 4}  # no variant lies in the fifth
    assert got[1].p == 1 and got[4].p == 1 and got[4].ties == 19  # carriers among controls only, and none
    assert got[2].p == 1 / 20 and got[3].p <= 0.2
