from pyspark.sql import functions as F

from docloom.streaming import ingest


def test_replayed_tasks_run_once(spark, tmp_path):
    source, target, failed = (str(tmp_path / x) for x in ("in", "out", "failed"))
    for n in range(2):
        spark.createDataFrame([(1, "a"), (2, "b")], "task_id long, text string").write.mode("append").parquet(source)
        q = ingest.ingest(ingest.stream(spark, source, "task_id long, text string"), lambda x: x, target, failed, str(tmp_path / "cp"))
        q.awaitTermination()
        assert spark.read.parquet(target).count() == 2, n


def test_state_counts_repeated_turns_once(spark, tmp_path):
    source = str(tmp_path / "turns")
    spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5)], "conv_id long, turn long").write.parquet(source)
    found = ingest.covered_turns(ingest.stream(spark, source, "conv_id long, turn long"))
    q = found.writeStream.outputMode("update").format("memory").queryName("covered").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("covered").collect()} == {(1, 2, 2), (2, 5, 1)}


def test_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    q = ingest.windowed_counts(ingest.stream(spark, source, events.schema)).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in batch.collect()}
