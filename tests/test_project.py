from genoforge import project as P
from genoforge.streaming import variants as V


def test_project(spark, tmp_path):
    p = P.Project(spark, str(tmp_path / "proj"))
    v = spark.createDataFrame([(k, 1, 100 * k, "f1" if k < 3 else "f2") for k in range(5)], "var_id long, chr int, bp1 long, file string")
    p.write("variants", v)
    p.append("variants", v.selectExpr("var_id + 10 AS var_id", "chr", "bp1", "file"))
    p.delete("variants", "file = 'f1'")
    assert sorted(r.var_id for r in p.read("variants").collect()) == [3, 4, 13, 14]
    p.rename("variants", "file", spark.createDataFrame([("f2", "new")], "old string, new string"))
    assert {r.file for r in p.read("variants").collect()} == {"new"}
    p.vacuum()
    assert p._versions("variants") == [4] and p.read("variants").count() == 4
    p.set_special("PAR", ["chrX:1-9", "chrY:1-9"])
    assert [r.value for r in p.special("PAR").collect()] == ["chrX:1-9", "chrY:1-9"]
    p.add_set("rare", v.where("var_id < 2"), "top")
    p.attach_meta("g", spark.createDataFrame([(3, "AF", "0.1")], "var_id long, key string, value string"))
    assert {r.var_id: r.meta for r in p.with_meta(p.read("variants")).collect()}[3] == {"AF": "0.1"}
    assert {r.table: r.rows for r in p.summary().collect()} == {"variants": 4, "special": 2, "var_sets": 2, "meta": 1}
    p.drop("special")
    assert p.tables() == ["meta", "var_sets", "variants"] and "v_freq" in P.commands() and "loc.req" in P.masks()


def test_streams(spark, tmp_path):
    calls = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 1, True), (2, 1, False)], "var_id long, ac int, is_null boolean")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = V.stream(spark, str(tmp_path / "in"), "var_id long, ac int, is_null boolean")
    q = V.running_counts(live).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r.var_id: (r.ac, r.het, r.nul) for r in spark.table("running").collect()} == {1: (3, 1, 1), 2: (1, 1, 0)}
    events = spark.range(6).selectExpr("timestamp_seconds(id * 3600) AS ts", "'a' AS event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    out = V.windowed_events(V.stream(spark, str(tmp_path / "ev"), "ts timestamp, event_type string"))
    V.append_to(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
