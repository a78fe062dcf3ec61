"""Minor alleles of variants whose ALT is common, views of them, merge modes and gene tests, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoforge.operators import association, genes, summaries, views
from genoforge.plans import genotypes, merge
from genoforge.plans.mask import mask
from genoforge.plans.study import Study


@pytest.fixture(scope="module")
def crossed(spark):
    """20 people and 6 variants, half of which have ALT as the commoner allele: the study and its whole matrix, None for missing."""
    r = np.random.default_rng(6)
    matrix = {}
    for v in range(6):
        for i in range(20):
            matrix[v, i] = None if r.random() < 0.1 else int(r.binomial(2, 0.85 if v % 2 else 0.1))
    people = [(i, i % 2, 1 + i % 2, float(i), i % 3) for i in range(20)]
    study = Study(
        variants=spark.createDataFrame([(v, 1, 100 + 10 * v, ".", "A", "G", 10.0 + v, "PASS") for v in range(6)], "var_id long, chr int, bp1 long, name string, ref string, alt string, qual double, filter string"),
        geno=spark.createDataFrame([(v, i, ac) for (v, i), ac in matrix.items() if ac != 0], "var_id long, indiv_id long, ac int"), calls=None,
        indiv=spark.createDataFrame(people, "indiv_id long, sex int, aff int, qt double, strata int"),
        loci=spark.createDataFrame([(1, 0, 1, 90, 125, "L1"), (2, 0, 1, 126, 200, "L2")], "loc_id long, group_id int, chr int, bp1 long, bp2 long, altname string"),
    )
    return study, matrix, {p[0]: p for p in people}


def flips(matrix):
    out = set()
    for v in range(6):
        called = [matrix[v, i] for i in range(20) if matrix[v, i] is not None]
        if sum(called) / (2 * len(called)) > 0.5:
            out.add(v)
    return out


def carries(matrix, flipped, v, i):
    ac = matrix[v, i]
    return ac is not None and (ac < 2 if v in flipped else ac > 0)


def test_minor_alleles_without_rows(crossed):
    study, matrix, people = crossed
    flipped = flips(matrix)
    assert len(flipped) == 3
    want = {(v, i) for v, i in matrix if carries(matrix, flipped, v, i)}
    assert {(r.var_id, r.indiv_id) for r in views.minor_carriers(study).collect()} == want
    got = {r.var_id: (r.in_group, r.outside) for r in summaries.unique(study, 1, 20).collect()}
    sides = {v: tuple(sum((v, i) in want and people[i][2] == aff for i in range(20)) for aff in (2, 1)) for v in range(6)}
    assert got == {v: s for v, s in sides.items() if s[0] >= 1}
    groups = {}
    for v in range(6):
        key = ",".join(map(str, sorted({people[i][4] for i in range(20) if (v, i) in want})))
        groups[key] = groups.get(key, 0) + 1
    assert {r.groups: r.n for r in summaries.group_comparison(study).collect()} == {k: n for k, n in groups.items() if k}
    for r in summaries.i_stats(study).collect():
        own = [v for v in range(6) if (v, r.indiv_id) in want]
        assert (r.qual or 0) == pytest.approx(np.mean([10.0 + v for v in own]) if own else 0)


def test_populations_by_all_genotypes(crossed):
    study, matrix, people = crossed
    size = {s: sum(p[4] == s for p in people.values()) for s in range(3)}
    freq = {(v, s): (sum(matrix[v, i] or 0 for i in range(20) if people[i][4] == s) + 0.5) / (2 * size[s] + 1) for v in range(6) for s in range(3)}
    for i in range(20):
        like = [np.prod([{0: (1 - f) ** 2, 1: 2 * f * (1 - f), 2: f * f}[matrix[v, i]] for v in range(6) if matrix[v, i] is not None for f in [freq[v, s]]]) for s in range(3)]
        got = {r["pop"]: r for r in summaries.i_pop(study).where(F.col("indiv_id") == i).collect()}
        assert [got[s].prob for s in range(3)] == pytest.approx([x / sum(like) for x in like], abs=1e-9)
        assert got[0].nvar == sum(matrix[v, i] is not None for v in range(6))


def test_canonical_correlation_is_multiple_correlation(crossed):
    study, matrix, people = crossed
    got = {r.loc_id: r for r in genes.cancor(study, 7).collect()}
    y = np.array([people[i][2] == 2 for i in range(20)], float)
    for loc, members in ((1, range(3)), (2, range(3, 6))):
        x = np.column_stack([np.ones(20)] + [[matrix[v, i] or 0 for i in range(20)] for v in members])
        fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        r2 = 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert got[loc].r == pytest.approx(r2**0.5) and got[loc].chi2 == pytest.approx(-(20 - 1 - 5 / 2) * np.log(1 - r2))


def test_permuted_statistics(crossed):
    study, *_ = crossed
    got = {(r.loc_id, r.test): r for r in genes.gene_assoc(study, (15, 30)).collect()}
    real = {r.loc_id: r for r in association.gene_tests(study).collect()}
    assert set(got) == {(k, t) for k in (1, 2) for t in genes.TESTS}
    for (k, test), r in got.items():
        assert 1 / (r.replicates + 1) <= r.p <= 1 and r.replicates in (15, 45) and r.i == pytest.approx(1 / (r.replicates + 1))
        if test in ("sumstat", "frqwgt", "vt"):
            assert r.stat == pytest.approx(real[k][test], nan_ok=True)  # common variants have no weight


def test_groups_and_exact_regions(crossed):
    study, *_ = crossed
    groups = mask(study, {"loc.group": [0], "qual": "12:"}).groups
    assert {(r.group, r.var_id) for r in groups.collect()} == {("L1", 2), ("L2", 3), ("L2", 4), ("L2", 5)}
    ids = lambda **t: sorted(r.var_id for r in mask(study, t).variants.collect())
    assert ids(ereg=["chr1:100", "chr1:110..112"]) == [0] and ids(**{"ereg.ex": ["chr1:100..100"]}) == [1, 2, 3, 4, 5]


def test_merge_modes(spark):
    rows = [(1, 1, 1, 100, "A", "G"), (2, 2, 1, 100, "A", "T"), (3, 3, 1, 100, "A", "AC"), (4, 1, 1, 200, "ACGT", "A"), (5, 2, 1, 202, "G", "C"), (6, 2, 1, 300, "A", "C,G"), (7, 3, 1, 300, "A", "C,GT")]
    sites = spark.createDataFrame(rows, "site_id long, file_id int, chr int, bp1 long, ref string, alt string")
    parts = lambda mode: sorted(sorted(x.site_id for x in g) for g in by(merge.merged(sites, mode)).values())
    assert parts("no-merge") == [[k] for k in range(1, 8)]
    assert parts("exact-merge") == [[1, 2], [3], [4], [5], [6], [7]]
    assert parts("any-merge") == [[1, 2, 3], [4, 5], [6, 7]]
    genos = spark.createDataFrame([(6, 1, 1, 2), (6, 2, 0, 1), (1, 1, 0, 1), (2, 1, 0, 1), (1, 2, None, None)], "site_id long, indiv_id long, a1 int, a2 int")
    got = {(r.var_id, r.indiv_id): r.genotype for r in merge.consensus(merge.merged(sites), genos).collect()}
    assert got == {(6, 1): "C/G", (6, 2): "A/C", (1, 1): None}
    down = sorted((r.site_id, r.alt, r.indiv_id, r.ac) for r in merge.downcoded(merge.merged(sites), genos).collect())
    assert down == [(1, "G", 1, 1), (2, "T", 1, 1), (6, "C", 1, 1), (6, "C", 2, 1), (6, "G", 1, 1)]


def by(sites):
    out = {}
    for r in sites.collect():
        out.setdefault(r.var_id, []).append(r)
    return out


def test_frequencies_by_expectation_and_maximisation(spark):
    r = np.random.default_rng(2)
    rows = [(v, i, *map(float, r.choice([0.05, 0.3, 0.9], 3))) for v in range(3) for i in range(40)]
    got = {x.var_id: x.f for x in genotypes.em_frequencies(spark.createDataFrame(rows, "var_id long, indiv_id long, l0 double, l1 double, l2 double")).collect()}
    for v in range(3):
        like, f = np.array([x[2:] for x in rows if x[0] == v]), 1 / 80
        for _ in range(10):
            p = like * [(1 - f) ** 2, 2 * f * (1 - f), f * f]
            p /= p.sum(1)[:, None]
            f, before = (p @ [0, 1, 2]).sum() / 80, f
            if abs(f - before) < 1e-4:
                break
        assert got[v] == pytest.approx(f)
