import datetime as dt

from pyspark.sql import functions as F

from siftline.streaming import progress


def test_share_and_gaps(spark):
    rows = spark.createDataFrame([("a", 5.0, 10.0), ("a", 3.0, 10.0), ("b", 1.0, 2.0)], "file string, loaded double, total double")
    plan = spark.createDataFrame([("a", 8.0), ("c", 10.0)], "file string, size double")
    got = progress.share(progress.per_file(rows), plan, 2.0).first()  # 2 + 18, a is larger by 2, b isn't in the plan
    assert (got.loaded, got.total, got.share) == (6.0, 24.0, 0.25)
    assert progress.share(progress.per_file(rows)).first().total == 12.0
    assert progress.share(progress.per_file(rows.limit(0))).first().share == 0.0
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    events = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("a", at(100))], "k string, t timestamp")
    assert [r.idle for r in progress.gaps(events, "k", "t").collect()] == [90.0]


def test_throttle(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.1, 0.1005, 0.05, 0.2, 0.995, 0.9951])], "f string, i int, s double")
    assert [r.i for r in progress.throttled(rows, "f", "i", "s").orderBy("i").collect()] == [0, 3, 4, 5]
    slow = spark.createDataFrame([("a", i, 0.1 + i / 1000, i // 4) for i in range(6)], "f string, i int, s double, attempt int")
    assert [r.i for r in progress.throttled(slow, "f", "i", "s").orderBy("i").collect()] in ([0, 2, 4], [0, 2, 5], [0, 3, 5])  # 0.002 more than the last told
    assert [r.i for r in progress.throttled(slow, "f", "i", "s", "attempt").orderBy("i").collect()][-1] == 4  # a new attempt starts anew
    assert progress.latest_attempt(slow, "attempt").count() == 2


def test_reports_and_stages(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    mb = float(1 << 20)
    rows = [("s", at(0), "progress", "w", mb, 4 * mb), ("s", at(1), "download", "w", None, None), ("s", at(1.2), "progress", "w", mb, 4 * mb), ("s", at(1.5), "progress", "w", 2 * mb, 4 * mb),
            ("s", at(1.6), "progress", "small", 10.0, 20.0), ("s", at(2.3), "progress", "w", 4 * mb, 4 * mb), ("s", at(2.4), "progress", "w", 4 * mb, 4 * mb)]
    told = progress.reported(spark.createDataFrame(rows, "session string, at timestamp, status string, file string, loaded double, total double"))
    assert [r.line for r in told.orderBy("at").collect()] == ["w is coming", "w: 1.0 of 4.0 MB", "w: 4.0 of 4.0 MB"]
    events = spark.createDataFrame([("k", at(0), False), ("k", at(100), False), ("k", at(101), True), ("k", at(110), True)], "k string, t timestamp, done boolean")
    found = sorted((r.stage, (r.at - at(0)).total_seconds()) for r in progress.stages(events, "k", "t", F.col("done")).collect())
    assert found == [("init", 105.0), ("slow", 45.0), ("slow", 90.0)]


def test_stream(spark, tmp_path):
    schema = "file string, at timestamp, share double"
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("a", at(0), 0.1), ("a", at(1), 0.1001), ("a", at(2), 0.4), ("b", at(1), 0.001)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = progress.told(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.file, r.share) for r in spark.table("told").collect()) == [("a", 0.1), ("a", 0.4), ("b", 0.001)]
    files = progress.per_file(stream.selectExpr("file", "share AS loaded", "1.0 AS total"))
    query = files.writeStream.format("memory").queryName("files").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert {r.file: r.loaded for r in spark.table("files").collect()} == {"a": 0.4, "b": 0.001}
