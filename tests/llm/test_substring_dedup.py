import hashlib

import pytest

from genoforge.llm import substring_dedup as S

from . import cases


def against_plain_python(documents, rows):
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in S.repeats_removed(documents).where("doc_id is not null").collect()}
    removed = 0
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += len(gone)
    return removed


@pytest.mark.parametrize("bucket", [S.BUCKET, 1])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = sorted((i, cases.words(t)) for i, t, *_ in cases.rows() if i is not None)
    assert against_plain_python(cases.documents(spark), rows) > 1000


@pytest.mark.parametrize("bucket,documents", [(1, 60), (3, 60), (S.BUCKET, 2500)])
def test_runs_of_one_word(spark, monkeypatch, bucket, documents):
    monkeypatch.setattr(S, "BUCKET", bucket)
    texts = ["a " * 30, "a " * 20, "x " + "a " * 15 + "y", "a b " * 40, "b a " * 9, "a b c " * 30, "c " + "a b c " * 6]
    texts += [f"u{k} v{k} " + "0 " * (13 + k % 40) + f"w{k} z{k}" for k in range(documents)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert against_plain_python(table, [(i, t.split()) for i, t in enumerate(texts)]) > 13 * documents


def test_nulls_and_empty(spark):
    got = S.repeats_removed(cases.documents(spark)).where("doc_id is null").collect()
    assert sorted(r.n_words for r in got) == [0, 2] and all(r.n_removed == 0 for r in got)
    assert S.repeats_removed(cases.empty(spark)).count() == 0
