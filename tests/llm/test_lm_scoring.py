import math
import zlib
from collections import Counter

import numpy as np
import pytest

from genoforge.llm import lm_scoring as L

from . import cases


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in cases.words(text)]


def model(rows, order, prior):
    """Plain Python: counts with all levels known exactly, no filter."""
    grams, kinds = Counter(), Counter()
    for i, text, *_ in rows:
        if not held(i):
            s = ["<", *tokens(text), ">"]
            kinds.update(s[1:])
            grams.update(tuple(s[k - m + 1 : k + 1]) for k in range(len(s)) for m in range(1, order + 1) if k - m + 1 >= 0)
    low = lambda c: 2 ** (c.bit_length() - 1) if c else 0
    high = lambda c: 2 ** c.bit_length() - 1 if c else 0
    n, v, floor = sum(kinds.values()), len(kinds), sum(low(c) for c in kinds.values())

    def score(text):
        s, out = ["<", *tokens(text), ">"], 0.0
        for k in range(1, len(s)):
            p = (low(grams[(s[k],)]) + 1) / (floor + v + 1)
            for m in range(2, order + 1):
                if k - m + 1 >= 0 and (h := high(grams[tuple(s[k - m + 1 : k])])):
                    p = (low(grams[tuple(s[k - m + 1 : k + 1])]) + prior * p) / (h + prior)
            out += math.log10(p)
        return out

    return n, v, kinds, score


@pytest.mark.parametrize("broadcast,slice_,hot", [(L.BROADCAST, L.SLICE, L.HOT), (0, 3000, 20), (L.BROADCAST, 5000, 0)])
def test_against_plain_python(spark, monkeypatch, broadcast, slice_, hot):
    for name, value in (("BROADCAST", broadcast), ("SLICE", slice_), ("HOT", hot), ("CHUNK", 9000), ("WORDS", 50), ("GATHERED", 20_000)):
        monkeypatch.setattr(L, name, value)
    rows = cases.rows()
    n, v, kinds, score = model(rows, L.ORDER, L.PRIOR)
    got = L.scored(cases.documents(spark), probes=16, room=20).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        t = tokens(text)
        want = (held(i), len(t) + 1, sum(kinds[x] > 0 for x in [*t, ">"]))
        found = [r for r in by[i] if (r.held_out, r.n_tokens, r.n_known) == want]
        assert found, (i, want)
        base = sum(math.log10((kinds[x] + 1) / (n + v + 1)) for x in [*t, ">"])
        assert any(math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score(text), rel_tol=1e-9, abs_tol=1e-9) for r in found), (i, base, score(text), found)


def test_levels_come_back():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << L.BITS, 30_000).astype(np.uint64))
    counts = np.random.default_rng(1).integers(1, 3000, len(h))
    bloom = L.LogBloom.of(h[::2], counts[::2])
    exact = np.array([int(c).bit_length() for c in counts])
    assert (bloom.levels(h[::2]) >= exact[::2]).all() and (bloom.levels(h[::2]) == exact[::2]).mean() > 0.9
    assert (bloom.levels(h[1::2]) > 0).mean() < 0.1


def test_probabilities_of_a_history_add_up_to_one_at_most():
    texts = [t.split() for t in (b"a b a b c", b"a b d", b"b b b a c a", b"", b"c c a b")]
    bloom = L.LogBloom.of(*np.unique(L.Grams(texts, 3).all(), return_counts=True), probes=16, room=20)
    counts = Counter(w for t in texts for w in [*t, L.END])
    floor = sum(1 << (c.bit_length() - 1) for c in counts.values())
    for history in ([], [b"a"], [b"b"], [b"a", b"b"], [b"c"], [b"strange"]):
        asked = [[*history, w] for w in (b"a", b"b", b"c", b"d", b"unknown")] + [history]  # the last for the end
        g = L.Grams(asked, 3)
        p = L.probabilities(g, L.spread(g, bloom.levels(g.all())), floor, len(counts), L.PRIOR)
        assert 0.5 < p[g.place == len(history) + 1].sum() <= 1 + 1e-12, history


def test_nothing_to_learn(spark):
    assert L.scored(cases.empty(spark)).count() == 0
    only = next(i for i in range(100) if held(i))
    r = L.scored(spark.createDataFrame([(only, "a b", *[None] * 11)], cases.SCHEMA)).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0)


def test_copies_of_training_texts_score_higher(spark):
    rows = {r.doc_id: r for r in L.scored(cases.documents(spark)).where("doc_id is not null").collect()}
    assert sum(r.score for r in rows.values() if r.n_tokens > 50) > sum(r.base_score for r in rows.values() if r.n_tokens > 50)
