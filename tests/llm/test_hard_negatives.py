import math
from math import floor

import numpy as np
import pytest

from genoforge.llm import hard_negatives as H

from . import vectors


def brute(rows):
    good, d = {}, max(len(v) for _, v, *_ in rows if v)
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        good[i] = ((label + 1) % 10 if i % 7 == 0 else label, [floor(256 * c) for c in v] + [0] * (d - len(v)))
    out = set()
    for a in good:
        if a % 100:
            continue
        dot = {i: sum(p * q for p, q in zip(x, good[a][1])) for i, (_, x) in good.items() if i != a}
        order = sorted(dot, key=lambda i: (-dot[i], i))
        for p in [i for i in order if good[i][0] == good[a][0]][:5]:
            fits = [i for i in order if good[i][0] != good[a][0] and 30 * dot[p] <= 100 * dot[i] <= 90 * dot[p]]
            out |= {(a, p, k + 1, i, dot[p], dot[i]) for k, i in enumerate(fits[:10])}
    return out


@pytest.mark.parametrize("leaf,entries", [(64, 4_000_000), (3, 600)])
def test_against_plain_python(spark, monkeypatch, leaf, entries):
    monkeypatch.setattr(H, "LEAF", leaf)
    monkeypatch.setattr(H, "TREE_ENTRIES", entries)
    rows = vectors.rows()
    got = [tuple(r) for r in H.hard_negatives(vectors.table(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_large_components_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=5) * 1e5], i % 3, *vectors.EXTRA) for i in range(250)]
    assert {tuple(r) for r in H.hard_negatives(vectors.table(spark, rows)).collect()} == brute(rows)


def test_bounds_skip_nodes():
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 16)) * 3000
    x = np.floor(np.concatenate([c + r.normal(size=(200, 16)) * 50 for c in centres])).astype(np.int64)
    tree = H.BallTree(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    visited = []
    plain = H.Search.leaf
    try:
        H.Search.leaf = lambda self, a, b, who: visited.append(len(who)) or plain(self, a, b, who)
        s = H.Search(tree, np.array([0]), np.array([0]), x[:1], np.array([[H.NONE + 1]]), np.array([[1 << 62]]), 5, True)
    finally:
        H.Search.leaf = plain
    score = x @ x[0]
    score[0] = H.NONE
    assert s.scores[0, 0].tolist() == sorted(score.tolist(), reverse=True)[:5]
    assert len(visited) < 0.2 * len(x) / H.LEAF * 2


def test_nothing(spark):
    assert H.hard_negatives(vectors.table(spark, [])).count() == 0
    assert H.hard_negatives(vectors.table(spark, [(0, [1.0], 1, *vectors.EXTRA)])).count() == 0
    assert H.hard_negatives(vectors.table(spark, [(0, [], 1, *vectors.EXTRA), (1, [], 1, *vectors.EXTRA), (2, [], 2, *vectors.EXTRA)])).collect()[0] == (0, 2, 1, 1, 0, 0)
