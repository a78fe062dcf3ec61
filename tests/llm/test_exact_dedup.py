import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from genoforge.llm import exact_dedup as X

from . import cases


def test_against_plain_python(spark):
    got = {(r.doc_id, r.text_sha256): r for r in X.exact_duplicates(cases.documents(spark)).collect()}
    groups = defaultdict(list)
    for i, t, *_ in cases.rows():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(cases.rows())
    for sha, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            r = got[i, sha]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)


def test_empty_table(spark):
    assert X.exact_duplicates(cases.empty(spark)).count() == 0


def test_filter_keeps_all_and_forgets_deleted():
    keys = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(3000)]
    shard = X.Shard()
    assert all([shard.insert(d, k, 1) for k, d in enumerate(keys)])
    assert shard.resizes > 0 and all(X.key_hash(d) in shard.filter for d in keys)
    assert not shard.insert(keys[5], 3, 2) and not shard.insert(keys[6], None, 1)
    held = {d: (k, c) for d, k, c in shard.keys()}
    assert len(held) == 3000 and held[keys[5]] == (3, 3) and held[keys[6]] == (6, 2)
    for d in keys[:1000]:
        shard.delete(d, 3)
    assert {d for d, _, _ in shard.keys()} == set(keys[1000:]) and all(X.key_hash(d) in shard.filter for d in keys[1000:])
    assert sum(X.key_hash(d) in shard.filter for d in keys[:1000]) < 20
    assert shard.insert(keys[1], 9, 1) and not shard.insert(keys[1], 8, 1)


def test_what_the_filter_denies_is_new():
    """Copies are found through the filter: one that forgets makes them new."""
    shard, digest = X.Shard(), hashlib.sha256(b"x").hexdigest()
    shard.insert(digest, 4, 5)
    shard.filter.cells[:] = 0
    assert shard.insert(digest, 7, 1) and list(shard.keys()) == [(digest, 7, 1)]


def test_equal_fingerprints_are_told_apart_by_content():
    shard, tail = X.Shard(), "00ab" + "0" * 11 + "7"
    digests = [f"{k:048x}" + tail for k in range(6)]
    assert all([shard.insert(d, k, 1) for k, d in enumerate(digests)]) and not any([shard.insert(d, 10, 1) for d in digests])


def test_index_inserts_and_deletes(spark):
    digests = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("doc_id"))
    index = X.CuckooIndex.empty(spark, 500).insert(digests).insert(digests.where("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 1000))
    index = index.delete(digests.where("doc_id < 50").select("digest")).delete(digests.where("doc_id < 50 or doc_id >= 400").select("digest"))
    live = {r.keep_id: r.copies for r in index.keys().collect()}
    assert set(live) == set(range(50, 400)) and live[60] == 2 and live[300] == 1
    assert index.probe(digests.where("doc_id between 50 and 399")).where("maybe").count() == 350
    assert index.probe(digests.where("doc_id >= 400")).where("maybe").count() < 5
    assert index.lookup(digests).where("keep_id is null").count() == 150
