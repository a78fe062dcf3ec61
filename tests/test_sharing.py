"""Sharing statistics and their permutations against plain Python."""

import numpy as np
import pytest

from genoforge.functions.permute import permuted
from genoforge.operators import sharing as H
from genoforge.plans.study import Study

REPLICATES = 6


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(21)
    people, variants = 60, 15
    case = r.random(people) < 0.4
    ac = (r.random((variants, people)) < 0.08) * r.integers(1, 3, (variants, people))
    lost = r.random((variants, people)) < 0.05
    segments = [(int(a), int(b), 1, int(s), int(s + w)) for a, b, s, w in zip(r.integers(0, people, 250), r.integers(0, people, 250), r.integers(0, 1400, 250), r.integers(50, 600, 250))]
    rows = [(v, i, None if lost[v, i] else int(ac[v, i])) for v in range(variants) for i in range(people) if ac[v, i] or lost[v, i]]
    study = Study(
        variants=spark.createDataFrame([(v, 1, 100 * v + 5) for v in range(variants)], "var_id long, chr int, bp1 long"), calls=None, geno=spark.createDataFrame(rows, "var_id long, indiv_id long, ac int"),
        indiv=spark.createDataFrame([(i, 2 if case[i] else 1, i % 2) for i in range(people)], "indiv_id long, aff int, strata long"),
        loci=spark.createDataFrame([(k, 1, 400 * k, 400 * k + 399) for k in range(4)], "loc_id long, chr int, bp1 long, bp2 long"),
        ibd=spark.createDataFrame(segments, "id1 long, id2 long, chr int, bp1 long, bp2 long"))
    sides = {(a, b, s, e) for x, y, _, s, e in segments if x != y for a, b in ((x, y), (y, x))}
    return study, case, np.where(lost, -1, ac), sides


def test_s_assoc_against_plain_python(made):
    study, case, ac, sides = made
    people = len(case)
    rank, of, cases = (np.zeros(people, int) for _ in range(3))
    for s in range(2):
        own = np.arange(people) % 2 == s
        rank[own], of[own], cases[own] = np.arange(own.sum()), own.sum(), case[own].sum()
    label = lambda key: permuted(rank, of, key) < cases
    draws = [(case, case), *[(label(k), label(H.APART + k)) for k in range(1, REPLICATES + 1)]]
    got = {x.loc_id: x for x in H.s_assoc(study, REPLICATES).collect()}
    for loc in range(4):
        own = [v for v in range(15) if 400 * loc <= 100 * v + 5 < 400 * (loc + 1)]
        stats = []
        for carrier, partner in draws:
            burden = aa = au = 0
            for v in own:
                held = np.flatnonzero(ac[v] > 0)
                a, u = carrier[held].sum(), (~carrier[held]).sum()
                burden += a if u == 0 else 0
                if a:
                    for i in held:
                        if case[i]:
                            met = [p for q, p, s, e in sides if q == i and s <= 100 * v + 5 <= e]
                            aa, au = aa + sum(partner[p] for p in met), au + sum(not partner[p] for p in met)
            stats.append((burden, aa, au))
        b, aa, au = stats[0]
        x = got[loc]
        assert (x.nvar, x.burden, x.aa, x.au) == (len(own), b, aa, au)
        assert x.p_burden == pytest.approx((1 + sum(s[0] >= b for s in stats[1:])) / (REPLICATES + 1))
        assert x.p_sharing == pytest.approx((1 + sum(s[1] - s[2] >= aa - au for s in stats[1:])) / (REPLICATES + 1))


def test_mutation_screen_against_plain_python(spark, made):
    study, _, ac, sides = made
    regions = [(i, 1, 300, 500) for i in range(0, 60, 2)]
    got = {(x.proband, x.var_id): tuple(x)[4:] for x in H.mutation_screen(study, spark.createDataFrame(regions, "proband long, chr int, bp1 long, bp2 long")).collect()}
    want = {}
    for i, _, low, high in regions:
        met = [(p, s, e) for q, p, s, e in sides if q == i and s <= high and e >= low]
        if not met:
            continue
        first, last = min(low, *[s for _, s, _ in met]), max(high, *[e for *_, e in met])
        partners = {p: max((s, e) for q, s, e in met if q == p) for p, *_ in met}
        for v in range(15):
            bp = 100 * v + 5
            if first <= bp <= last:
                x = ac[v, i]
                near = [ac[v, p] for p, (s, e) in partners.items() if s <= bp <= e]
                both = [y for y in near if x >= 0 and y >= 0]
                want[i, v] = (None if x < 0 else x, len(near), len(both), sum({int(x), int(y)} == {0, 2} for y in both), *[sum(x == 1 and y == k for y in both) for k in (0, 2, 1)])
    assert got == want and len(want) > 100
