from collections import defaultdict

import duckdb

from genoforge.llm import mixing

from . import cases


def test_against_sql(spark):
    docs = cases.documents(spark)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.size), (r.source_size, round(r.target, 6), r.taken, r.copies)) for r in mixing.mixed(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(f"select doc_id, size, source_size, target, taken, copies from ({mixing.SQL})").fetchall()
    assert got == sorted(((w[0] is None, w[0] or 0, w[1]), (w[2], round(w[3], 6), w[4], w[5])) for w in want)


def test_targets_are_met(spark):
    source = {r[0]: r[3] for r in cases.rows()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in mixing.mixed(cases.documents(spark)).where("doc_id is not null").collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 3 * r.size and r.size == len(cases.words(dict((x[0], x[1]) for x in cases.rows())[r.doc_id]))
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 3
    assert mixing.mixed(cases.empty(spark)).count() == 0


def test_stops_share_out(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 980)], "source string, source_size long")
    weights = spark.createDataFrame([("a", 8.0), ("b", 1.0), ("c", 1.0)], "source string, weight double")
    got = {r.source: r.target for r in mixing.targets(sizes, weights).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 940.0}
