from attesta.streaming import incremental


def test_upsert_stream(spark, tmp_path):
    schema = "id long, v string, at int"
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    batches = [[(1, "a", 1), (2, "b", 2), (1, "older", 0)], [(2, "c", 3), (3, "d", 1), (1, "late", 0)], [(4, "e", 1)], [(4, "f", 2)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")
        incremental.upsert_stream(incremental.file_stream(spark, f"{source}/*", schema), target, "id", check, "at").awaitTermination()
    assert {(r["id"], r["v"]) for r in incremental.current(spark, target).collect()} == {(1, "a"), (2, "c"), (3, "d"), (4, "f")}
    assert len(list((tmp_path / "out").glob("g=*"))) == 2


def test_once_by_content(spark, tmp_path):
    schema = "ts timestamp, v string"
    spark.sql("select timestamp'2024-01-01 00:00:00' as ts, v from values ('a'), ('a'), ('b') t(v)").write.parquet(str(tmp_path / "in"))
    out = incremental.once_by_content(incremental.file_stream(spark, str(tmp_path / "in"), schema), "ts", ["v"], "1 hour")
    q = out.writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
