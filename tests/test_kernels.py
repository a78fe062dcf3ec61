"""SKAT-O, tails of chi-square sums, STEPUP and keyed permutations against simulation and plain Python."""

import itertools

import numpy as np
import pytest

from genoforge.functions.permute import permuted
from genoforge.functions.stats import chi2_tail
from genoforge.functions.tails import chi2_quantile, weighted_chi2_tail
from genoforge.operators import association as A
from genoforge.operators import genes as G
from genoforge.plans.study import Study


@pytest.mark.parametrize("weights", [[1.0], [2.0, 2.0, 2.0], [3.0, 1.0], [5.0, 1.0, 0.01], list(np.linspace(0.1, 4, 12)), [10.0, *[0.1] * 40]])
def test_tail_against_simulation(weights):
    r, w = np.random.default_rng(4), np.array(weights)
    drawn = np.concatenate([(r.normal(size=(200_000, len(w))) ** 2) @ w for _ in range(10)])
    q = np.quantile(drawn, [0.02, 0.3, 0.8, 0.99, 0.9995])
    got = weighted_chi2_tail(q, w)
    assert got is not None and np.abs(got - [0.98, 0.7, 0.2, 0.01, 0.0005]).max() < 1e-3 and abs(got[-1] - 0.0005) < 8e-5


def test_tail_of_equal_weights_and_far_out():
    w = np.array([1.0, 1.0 + 1e-6, 1.0, 1.0])
    for q in (0.5, 4.0, 30.0):
        assert np.isclose(weighted_chi2_tail(q, w)[0], chi2_tail(q, 4), rtol=1e-3, atol=1e-8)
    assert np.isclose(chi2_tail(chi2_quantile(0.01, 2.7), 2.7), 0.01)


def test_skat_o_keeps_its_level():
    r = np.random.default_rng(8)
    x = (r.random((600, 7)) < [0.02, 0.05, 0.1, 0.03, 0.2, 0.01, 0.04]) * 1.0
    x[:, 2] = np.where(r.random(600) < 0.6, x[:, 1], x[:, 2])
    spread = np.cov(x.T, bias=True) * 600 * 0.25
    root = np.linalg.cholesky(spread)
    p = np.array([A.optimal_p(root @ r.normal(size=7), spread)[2] for _ in range(1500)])
    for level in (0.5, 0.2, 0.05):
        assert abs((p < level).mean() - level) < 4 * np.sqrt(level * (1 - level) / len(p)) + 0.01, level
    burden = np.full(7, 1.0) * 2.5 * np.sqrt(spread.sum()) / 7
    alternating = burden * [1, -1, 1, -1, 1, -1, 1]
    assert A.optimal_p(burden, spread)[0] > A.optimal_p(alternating, spread)[0] == 0
    assert A.optimal_p(np.array([3.0]), np.array([[1.0]]))[2] == pytest.approx(chi2_tail(9.0, 1), rel=1e-6)


def test_keyed_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        seen = [tuple(permuted(np.arange(n), np.full(n, n), key)) for key in range(20)]
        assert all(sorted(s) == list(range(n)) for s in seen) and (n < 7 or len(set(seen)) == 20)
    first = np.array([permuted(np.array([0]), np.array([5]), key)[0] for key in range(4000)])
    assert np.abs(np.bincount(first, minlength=5) / 4000 - 0.2).max() < 0.03
    pairs = np.array([permuted(np.array([0, 1]), np.array([3, 3]), key) for key in range(4000)])
    assert np.abs(np.bincount(pairs[:, 0] * 3 + pairs[:, 1], minlength=9)[[1, 2, 3, 5, 6, 7]] / 4000 - 1 / 6).max() < 0.03


def plain_stepup(x, case):
    """Selection that computes every statistic over people anew."""
    k, t = x.shape[1], case - case.mean()
    xm = x - x.mean(0)
    sign = np.sign(np.round(xm.T @ t, 12))

    def stat(m):
        each = sum(sign[j] * xm[:, j] * t for j in range(k) if m[j]) + np.zeros(len(x))
        return each.sum() ** 2 / (each**2).sum() if (each**2).sum() > 1e-15 else -1

    size = k if k <= 15 else k // (k // 15 + 1) + 1
    masks = []
    for a in range(0, k, size):
        m, best = [0] * k, 0
        while True:
            trial = [(stat([v or i == j for i, v in enumerate(m)]), j) for j in range(a, min(a + size, k)) if not m[j]]
            top = max(trial, key=lambda z: (z[0], -z[1]), default=(0, 0))
            if top[0] <= best + 1e-12:
                break
            best, m[top[1]] = top[0], 1
        masks.append(m)
    final, best, left = [0] * k, 0, set(range(len(masks)))
    while left:
        top = max((stat([u or v for u, v in zip(final, masks[i])]), -i) for i in left)
        if top[0] <= best + 1e-12:
            break
        best = top[0]
        final = [u or v for u, v in zip(final, masks[-top[1]])]
        left.remove(-top[1])
    return best


def test_stepup_against_plain_python(spark):
    r = np.random.default_rng(5)
    people, sizes = 120, [1, 4, 19]
    case = r.random(people) < 0.4
    stratum = np.arange(people) % 3
    variants, geno, x = [], [], {}
    for loc, k in enumerate(sizes):
        x[loc] = (r.random((people, k)) < r.uniform(0.03, 0.2, k)) * r.integers(1, 3, (people, k))
        x[loc][0, :] = np.maximum(x[loc][0, :], 1)
        for j in range(k):
            var = loc * 100 + (k - j)  # ids fall where positions rise
            variants.append((var, 1, 1000 * loc + 10 * j + 5))
            geno += [(var, i, int(x[loc][i, j])) for i in range(people) if x[loc][i, j]]
    study = Study(
        variants=spark.createDataFrame(variants, "var_id long, chr int, bp1 long"), calls=None, geno=spark.createDataFrame(geno, "var_id long, indiv_id long, ac int"),
        indiv=spark.createDataFrame([(i, 2 if case[i] else 1, int(stratum[i])) for i in range(people)], "indiv_id long, aff int, strata long"),
        loci=spark.createDataFrame([(loc, 1, 1000 * loc, 1000 * loc + 999) for loc in range(len(sizes))], "loc_id long, chr int, bp1 long, bp2 long"))
    got = {z.loc_id: z for z in G.stepup(study, replicates=19, block=50).collect()}
    rank, of = np.zeros(people, int), np.zeros(people, int)
    cases = np.zeros(people, int)
    for s in range(3):
        own = np.flatnonzero(stratum == s)
        rank[own], of[own], cases[own] = np.arange(len(own)), len(own), case[own].sum()
    labels = [case, *[permuted(rank, of, rep) < cases for rep in range(1, 20)]]
    assert all(label.sum() == case.sum() for label in labels)
    for loc, k in enumerate(sizes):
        z = [plain_stepup(x[loc], label * 1.0) for label in labels]
        assert got[loc].nvar == k and got[loc].stepup == pytest.approx(z[0], rel=1e-9)
        assert got[loc].p == pytest.approx((1 + sum(v >= z[0] - 1e-9 for v in z[1:])) / 20)
    best = G.stepped_up(np.array([3.0, -2.0, 0.5]), np.diag([4.0, 3.0, 9.0]))
    assert best == max((sum(abs(c) for c, m in zip((3, -2, 0.5), pick) if m)) ** 2 / sum(d for d, m in zip((4, 3, 9), pick) if m) for pick in itertools.product((0, 1), repeat=3) if any(pick))


def test_inflation_and_residuals(spark):
    r = np.random.default_rng(3)
    z = r.normal(size=(200, 3))
    z[:, 2] = z[:, 0] + 0.2 * z[:, 2]
    others = [np.delete(np.arange(3), k) for k in range(3)]
    r2 = [1 - np.var(z[:, k] - np.column_stack([np.ones(200), z[:, o]]) @ np.linalg.lstsq(np.column_stack([np.ones(200), z[:, o]]), z[:, k], rcond=None)[0]) / np.var(z[:, k]) for k, o in enumerate(others)]
    assert A.inflation(np.cov(z.T)) == pytest.approx(max(1 / (1 - x) for x in r2))
    assert A.inflation(np.zeros((2, 2))) == float("inf")
    y = 2 * z[:, 0] - z[:, 1] + r.normal(size=200)
    table = spark.createDataFrame([(i, *map(float, z[i]), float(z[i, 0]), None if i == 7 else float(y[i])) for i in range(200)], "indiv_id long, a double, b double, c double, again double, qt double")
    got = {x.indiv_id: x.residual for x in A.residuals(Study(variants=None, calls=None, geno=None, indiv=table), ("a", "b", "c", "again")).collect()}
    keep = np.arange(200) != 7
    x = np.column_stack([np.ones(199), z[keep]])
    want = y[keep] - x @ np.linalg.lstsq(x, y[keep], rcond=None)[0]
    assert 7 not in got and np.allclose([got[i] for i in np.flatnonzero(keep).tolist()], want, atol=1e-9)
