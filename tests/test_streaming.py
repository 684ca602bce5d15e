from strandline import streaming


def test_sessions(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    import shutil

    shutil.copy(path, (tmp_path / "in.parquet"))
    got = streaming.session_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "*.parquet")), late="0 seconds")
    q = got.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.sql("select sum(n) from sessions").first()[0]
    assert 0 < n <= spark.read.parquet(path).count()
