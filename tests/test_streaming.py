from terrace.streaming.reports import report_stream, unit_counts


def test_each_batch_is_reported_once(spark, tmp_path):
    schema = "adm1_code string, adm1_name string, at timestamp"
    spark.sql("SELECT 'A' AS adm1_code, 'x' AS adm1_name, timestamp'2024-01-01 00:10:00' AS at UNION ALL SELECT NULL, 'y', timestamp'2024-01-01 00:20:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    report_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.kind, r.batch) for r in found] == [("blank-code", 0)]
    counts = unit_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "adm1_code", "at")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.code or "", r.n) for r in spark.table("counts").collect()) == [("", 1), ("A", 1)]
