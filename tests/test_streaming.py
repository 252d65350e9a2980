from orelode.operators import aggregates
from orelode.streaming import aggregates as streaming


def test_running_word_count(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two\ntwo three.\n")
    (tmp_path / "in" / "b.txt").write_text("three, three\n")
    stream = streaming.running_word_count(spark.readStream.text(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("words").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    batch = aggregates.word_count(spark.read.text(f"{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("words").collect())) == sorted(map(tuple, batch.collect())) == [("one", 1), ("three", 3), ("two", 2)]


def test_windowed_mean(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 1.0), (60, "a", 3.0), (4000, "a", 5.0), (30, "b", 2.0)], "s long, k string, v double").selectExpr("timestamp_seconds(s) as ts", "k", "v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming.windowed_mean(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "k", "v")
    run = stream.writeStream.format("memory").queryName("means").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    got = {(r["start"].timestamp() % 86400 // 3600, r["k"]): (r["mean"], r["n"]) for r in spark.table("means").collect()}
    assert sorted(got.values()) == [(2.0, 1), (2.0, 2), (5.0, 1)]


def test_running_mean(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None), (None, 4.0)], "k string, v double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming.running_mean(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k", "v")
    run = stream.writeStream.format("memory").queryName("run").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("run").collect()} == {("a", 2.0, 2), ("b", 2.0, 1), (None, 4.0, 1)}
