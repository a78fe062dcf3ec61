"""Network association, its replicates and corrected p values against plain Python."""

import numpy as np
import pytest

from genoforge.functions.permute import permuted
from genoforge.operators import network as N
from genoforge.plans.study import Study

REPLICATES = 7


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(11)
    people, loci = 90, 24
    case = r.random(people) < 0.45
    stratum = np.arange(people) % 2
    carry = r.random((loci, people)) < r.uniform(0.01, 0.06, loci)[:, None]
    carry[3] = False
    edges = {(a, b) for a, b in r.integers(0, loci, (60, 2)).tolist() if a != b}
    edges |= {(b, a) for a, b in edges}
    study = Study(
        variants=spark.createDataFrame([(v, 1, 100 * v + 5) for v in range(loci)], "var_id long, chr int, bp1 long"), calls=None,
        geno=spark.createDataFrame([(v, i, 1 + i % 2) for v in range(loci) for i in range(people) if carry[v, i]], "var_id long, indiv_id long, ac int"),
        indiv=spark.createDataFrame([(i, 2 if case[i] else 1, int(stratum[i])) for i in range(people)], "indiv_id long, aff int, strata long"),
        loci=spark.createDataFrame([(v, 1, 100 * v, 100 * v + 99) for v in range(loci)], "loc_id long, chr int, bp1 long, bp2 long"),
        edges=spark.createDataFrame([(a, b, 0.5) for a, b in sorted(edges)], "a long, b long, score double"))
    rank, of, cases = (np.zeros(people, int) for _ in range(3))
    for s in range(2):
        own = np.flatnonzero(stratum == s)
        rank[own], of[own], cases[own] = np.arange(len(own)), len(own), case[own].sum()
    labels = [case, *[permuted(rank, of, rep) < cases for rep in range(1, REPLICATES + 1)]]
    counts = [{v: (int((carry[v] & c).sum()), int((carry[v] & ~c).sum())) for v in range(loci) if carry[v].any()} for c in labels]
    return study, edges, counts, int(case.sum()), people - int(case.sum())


def chi2(a, b, na, nu):
    if a == b == 0:
        return -1.0
    c, d = na - a, nu - b
    if c < 0 or d < 0:
        return None
    m = (a + b) * (c + d) * (a + c) * (b + d)
    return 0.0 if m <= 1e-10 else (a + b + c + d) * (a * d - b * c) ** 2 / m


def plain_growth(seed, counts, edges, na, nu):
    a, b = counts[seed]
    stat, taken = chi2(a, b, na, nu), {}
    near = lambda x: sorted(v for u, v in edges if u == x)
    nodes = {v: (None, 1) for v in near(seed)}
    live = set(nodes)
    while True:
        best, bar = None, stat
        for v in sorted(live):
            z = chi2(a + counts[v][0], b + counts[v][1], na, nu) if v in counts else None
            if z is not None and z > bar:
                best, bar = v, z
            else:
                live.discard(v)
        if best is None:
            return stat, a, b, taken
        live.discard(best)
        a, b, stat = a + counts[best][0], b + counts[best][1], bar
        taken[best] = nodes[best][0]
        if nodes[best][1] == 1:
            for v in near(best):
                if v != seed and v not in nodes:
                    nodes[v] = (best, 2)
                    live.add(v)


def test_growth_against_plain_python(made):
    study, edges, counts, na, nu = made
    got = {x.seed: x for x in N.net_assoc(study, REPLICATES).collect()}
    assert set(got) == set(counts[0])
    partners = {(x.seed, x.node): (x.parent, x.ca, x.cu) for x in N.net_partners(study).collect()}
    want, sizes = {}, set()
    for seed in counts[0]:
        stats = [plain_growth(seed, c, edges, na, nu) for c in counts]
        stat, a, b, taken = stats[0]
        x = got[seed]
        assert (x.ca, x.cu, x.size, x.nvar) == (a, b, len(taken) + 1, len(taken) + 1) and x.chi2 == pytest.approx(stat)
        assert x.p == pytest.approx((1 + sum(s[0] >= stat - 1e-9 for s in stats[1:])) / (REPLICATES + 1))
        assert x.links == len({v for u, v in edges if u == seed})
        want |= {(seed, v): (parent, *counts[0][v]) for v, parent in taken.items()}
        sizes.add(len(taken))
    assert partners == want and len(sizes) > 3 and any(p is not None for p, *_ in want.values())


def test_largest_over_sets(made):
    study, _, counts, na, nu = made
    stat = {"cases": lambda c: float(c[0]), "chi2": lambda c: chi2(*c, na, nu)}
    for x in N.smp(study, REPLICATES).collect():
        f = stat[x.test]
        assert x.stat == pytest.approx(f(counts[0][x.set]))
        tops = [max(f(v) for v in c.values()) for c in counts[1:]]
        assert x.p == pytest.approx((1 + sum(f(c[x.set]) >= x.stat for c in counts[1:])) / (REPLICATES + 1))
        assert x.p_corrected == pytest.approx((1 + sum(t >= x.stat for t in tops)) / (REPLICATES + 1))


def test_permuted_single_variants(spark):
    r = np.random.default_rng(2)
    people, variants = 80, 6
    case, stratum = r.random(people) < 0.5, np.arange(people) % 2
    ac = r.choice([0, 0, 0, 1, 2, -1], (variants, people))
    study = Study(
        variants=None, calls=None, geno=spark.createDataFrame([(v, i, None if ac[v, i] < 0 else int(ac[v, i])) for v in range(variants) for i in range(people) if ac[v, i]], "var_id long, indiv_id long, ac int"),
        indiv=spark.createDataFrame([(i, 2 if case[i] else 1, int(stratum[i])) for i in range(people)], "indiv_id long, aff int, strata long"))
    rank, of, cases = (np.zeros(people, int) for _ in range(3))
    for s in range(2):
        own = np.flatnonzero(stratum == s)
        rank[own], of[own], cases[own] = np.arange(len(own)), len(own), case[own].sum()
    labels = [case, *[permuted(rank, of, rep) < cases for rep in range(1, 10)]]

    def table(a, b, c, d):
        m = (a + b) * (c + d) * (a + c) * (b + d)
        return (a + b + c + d) * (a * d - b * c) ** 2 / m if m > 1e-10 else 0.0

    def three(v, label):
        n = [[int(((ac[v] == k) & (label == side)).sum()) for k in range(3)] for side in (True, False)]
        (r1, h1, o1), (r0, h0, o0) = n
        return table(h1 + 2 * o1, 2 * r1 + h1, h0 + 2 * o0, 2 * r0 + h0), table(h1 + o1, r1, h0 + o0, r0), table(o1, r1 + h1, o0, r0 + h0)

    for x in N.v_assoc_permuted(study, 9).collect():
        stats = [three(x.var_id, label) for label in labels]
        for k, (stat, p) in enumerate(((x.chi2, x.p), (x.chi2dom, x.pdom), (x.chi2rec, x.prec))):
            assert stat == pytest.approx(stats[0][k]) and p == pytest.approx((1 + sum(s[k] >= stats[0][k] - 1e-9 for s in stats[1:])) / 10)
