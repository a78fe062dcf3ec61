"""Sums over labels as bits, rows of a key in one task, and regressions in batches, against plain NumPy."""

import numpy as np
import pandas as pd
import pytest

from genoforge.functions.permute import permuted
from genoforge.operators import association, replicates


def test_labels_are_drawn_once_and_summed_by_key(spark):
    r = np.random.default_rng(5)
    n, rank, cases = 90, np.arange(90), 30
    aff = np.where(r.permutation(n) < cases, 2, 1)
    ranks = spark.createDataFrame([(i, int(aff[i]), i, n, cases) for i in range(n)], "indiv_id long, aff int, rank int, of long, cases long")
    rows = [(k, i) for k in range(7) for i in range(n) if r.random() < 0.3]
    carried = spark.createDataFrame(rows, "key long, indiv_id long").join(replicates.labelled(ranks, 9), "indiv_id")
    labels = np.array([aff == 2, *[permuted(rank, np.full(n, n), rep) < cases for rep in range(1, 10)]])
    got = {x.key: x for x in replicates.label_sums(carried, "key", 9).collect()}
    for k in range(7):
        own = [i for key, i in rows if key == k]
        assert got[k].n == len(own) and got[k].ca == labels[:, own].sum(1).tolist()
    plan = replicates.label_sums(carried, "key", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "rep#" not in plan  # no row for each replicate


def test_rows_of_a_key_over_batches():
    batches = lambda: iter([pd.DataFrame({"k": k, "who": w, "x": x}) for k, w, x in (([1, 1, 2], [1, 2, 1], [1, 2, 3]), ([2, 2], [2, 2], [4, 5]), ([2, 3], [3, 1], [6, 7]))])
    out = [(int(k), int(s[0])) for keys, sums in replicates.summed(batches(), "k", lambda p: p[["x"]].to_numpy()) for k, s in zip(keys, sums)]
    assert out == [(1, 3), (2, 18), (3, 7)]
    assert [p["k"].tolist() for p in replicates.whole_keys(batches(), "k")] == [[1, 1], [2, 2, 2, 2], [3]]
    arrays = lambda p: {c: p[c].to_numpy() for c in p}
    assert [(int(k), v["x"].tolist(), last) for k, v, last in replicates.pieces(batches(), "k", "who", arrays, 2)] == [(1, [1, 2], True), (2, [3], False), (2, [4, 5, 6], True), (3, [7], True)]


def test_products_in_parts_are_those_of_the_whole():
    r = np.random.default_rng(8)
    x, labels = r.choice([0, 0, 1, 2], (50, 6)), r.integers(0, 2, (50, 4)).astype(np.uint8)
    at = [(i, v) for i in range(50) for v in range(6) if x[i, v]]
    rows = {"indiv_id": np.array([i for i, _ in at]), "var_id": np.array([v for _, v in at]), "ac": np.array([x[a] for a in at]), "bp1": np.array([v * 10 for _, v in at]), "labels": labels[[i for i, _ in at]]}
    for cut in (0, 60):
        of = association.Products()
        start = 0
        for end in sorted({next(k for k in range(cut, len(at)) if k == 0 or at[k][0] != at[k - 1][0]), len(at)} - {0}):
            of.add({c: v[start:end] for c, v in rows.items()}, 7)
            start = end
        assert (of.ids == range(6)).all() and (of.bp == np.arange(6) * 10).all() and (of.xx == x.T @ x).all() and (of.s == x.sum(0)).all()
        for rep in range(4):
            own = x[labels[:, rep] == 1]
            assert (of.c[rep] == own.sum(0)).all() and of.xc[rep] == pytest.approx(own.T @ own)


def test_logistic_regressions_of_many_weights():
    r = np.random.default_rng(1)
    x, y = np.column_stack([np.ones(12), np.tile([0, 1, 2], 4), np.repeat([0, 1], 6)]).astype(float), np.tile([0.0, 1.0], 6)
    w = r.integers(0, 9, (40, 12)).astype(float)
    w[0, x[:, 1] > 0] = 0  # no carrier: singular
    b, se = association.regressions(x, y, w, np.ones(40, bool))
    for k in range(40):
        one = association.regression(x[w[k] > 0], y[w[k] > 0], True, w=w[k][w[k] > 0])
        assert np.isnan(b[k]) if one is None else (b[k], se[k]) == (pytest.approx(one[0][1]), pytest.approx(one[1][1]))
