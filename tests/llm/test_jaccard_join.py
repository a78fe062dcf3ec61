import random
from itertools import combinations

import pytest

from genoforge.llm import jaccard_join as J

from . import cases


def brute(rows, width, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = cases.words((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            part[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_against_all_pairs(spark, width, num, den):
    rows = [(i, t) for i, t, *_ in cases.rows() if i is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_groups(cases.documents(spark).where("doc_id is not null"), width, num, den).collect()}
    assert got == brute(rows, width, num, den)


def test_copies_of_copies(spark):
    """A family in which links also run between members far from any leader."""
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    family = [[r.choice(vocabulary) for _ in range(90)]]
    for _ in range(220):
        words = list(r.choice(family))
        for _ in range(r.choice([0, 1, 1, 1, 2, 4])):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
        family.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(family)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, num, den in ((3, 90, 100), (5, 8, 10)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.similar_groups(docs, width, num, den).collect()}
        assert got == brute(rows, width, num, den)


def test_nulls_and_empty(spark):
    got = J.similar_groups(cases.documents(spark)).where("doc_id is null").collect()
    assert sorted(r.n_shingles for r in got) == [0, 1] and all(r.component_id is None for r in got)
    assert J.similar_groups(cases.empty(spark)).count() == 0
