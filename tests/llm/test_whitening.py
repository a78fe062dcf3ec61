import math
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from genoforge.llm import whitening as W

from . import vectors


def test_jacobi_keeps_small_eigenvalues():
    r = np.random.default_rng(2)
    for d in (2, 7, 32, 33):
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        m = q @ np.diag(np.linspace(1, 5, d)) @ q.T
        e, v = W.jacobi((m + m.T) / 2)
        assert np.allclose(e, np.linspace(5, 1, d), rtol=1e-13) and np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(v * e @ v.T, m, atol=1e-12)
    scale = np.logspace(0, -9, 6)  # graded: the smallest eigenvalue is 1e-18 of the largest
    base = np.eye(6) + 0.1
    graded = base * np.outer(scale, scale)
    small = 1 / np.linalg.eigvalsh(np.linalg.inv(base) / np.outer(scale, scale))[::-1]
    e, _ = W.jacobi(graded)
    assert np.allclose(e[::-1][:3], small[:3], rtol=1e-12) and np.allclose(e[:3], np.linalg.eigvalsh(graded)[::-1][:3], rtol=1e-6)


def test_against_numpy(spark):
    rows = vectors.rows()
    good = [(i, list(v) + [0.0] * (6 - len(v))) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[floor(1024 * c) + 100000 for c in v] for _, v in good]
    n, total = len(x), np.sum(x, axis=0)
    z = (n * np.array(x) - total) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    y = z @ v[:, ::-1] / np.sqrt(e[::-1])
    got = W.whitened(vectors.table(spark, rows)).toPandas()
    assert len(got) == 6 * n and got["n"].eq(n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    deviation = [int(sum((n * a - t) ** 2 for a, t in zip(row, total.tolist()))) for row in x]
    key = lambda i: -1 if i is None else i
    for k in range(6):
        part = got[got["component"] == k + 1]
        assert np.allclose(part["explained"], e[::-1][k] / e.sum(), rtol=1e-9)
        mine = sorted(zip(part["vec_id"].fillna(-1).astype(int), part["deviation"], part["whitened"]))
        for sign in (1, -1):
            want = sorted(zip([key(i) for i, _ in good], deviation, sign * y[:, k]))
            if np.allclose([w for *_, w in mine], [w for *_, w in want], atol=1e-9):
                break
        else:
            pytest.fail(f"component {k + 1}")
        assert [m[:2] for m in mine] == [w[:2] for w in want]


def test_nothing_to_whiten(spark):
    assert W.whitened(vectors.table(spark, [])).count() == 0
    got = W.whitened(vectors.table(spark, [(1, [1.0, 2.0], 1, *vectors.EXTRA)] * 3)).collect()
    assert len(got) == 6 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.explained == 0 for r in got)
    flat = W.whitened(vectors.table(spark, [(i, [float(i), 2.0], 1, *vectors.EXTRA) for i in range(4)])).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 4 + [True] * 4


def test_sums_beyond_longs():
    total = np.array([0, 1 << 61], object)
    z = W.centred(np.array([[1 << 40, 5], [-(1 << 40), 7]], np.int64), 1 << 30, total)
    assert z.tolist() == [[1 << 70, (5 << 30) - (1 << 61)], [-(1 << 70), (7 << 30) - (1 << 61)]]
    assert W.squares(z) == [None, None] and W.squares(np.array([[3, 4]], object)) == [25]
    assert Fraction(W.centred(np.array([[3]], np.int64), 7, np.array([5], object))[0, 0].item()) == 16
