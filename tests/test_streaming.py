from ephyspark.streaming.pauses import sessions, upsert_stream


def test_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "c int, t string").selectExpr("c", "cast(t AS timestamp) AS t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, "c", "t").writeStream.format("memory").queryName("s").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.c, r.n_packets) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_upsert_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "f string, x int").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("f string, x int").parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), "f", str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("a", 5)], "f string, x int").write.mode("append").parquet(str(tmp_path / "in"))
    assert {(r.f, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 5), ("b", 2)}
