from lectern.streaming import cache_stream


def test_stream_of_puts_becomes_snapshots(spark, tmp_path):
    schema = "key string, entity_type string, value string, created_at timestamp, expires_at timestamp"
    (tmp_path / "in").mkdir()
    for i, v in enumerate(("old", "new")):
        spark.sql(f"select 'k' key, 'journal' entity_type, '{v}' value, timestamp'2024-01-0{i + 1}' created_at, timestamp'2024-02-01' expires_at").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(cache_stream.upsert_into(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.value for r in spark.read.parquet(f"{out}/run-1").collect()] == ["new"]
    assert cache_stream.newest(spark, out) == f"{out}/run-1" and cache_stream.newest(spark, out, but="run") is None
    # a stream with a new checkpoint keeps what is there
    (tmp_path / "in2").mkdir()
    spark.sql("select 'other' key, 'journal' entity_type, 'x' value, timestamp'2024-01-09' created_at, timestamp'2024-02-01' expires_at").coalesce(1).write.parquet(str(tmp_path / "in2" / "b"))
    again = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in2"))
    q = again.writeStream.foreachBatch(cache_stream.upsert_into(out, "second")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.key: r.value for r in spark.read.parquet(f"{out}/second-0").collect()} == {"k": "new", "other": "x"}


def test_windowed_puts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.selectExpr("cast(user_id as string) key", "event_type entity_type", "ts created_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, entity_type string, created_at timestamp_ntz").parquet(str(tmp_path / "in"))
    q = cache_stream.puts_by_window(stream, "1 day").writeStream.format("memory").queryName("puts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(puts) n from puts").first().n == events.count()
