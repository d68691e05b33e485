"""A stream that is opened: files arrive, windows close by watermark, and the rows equal the batch's."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.streaming.windows import window_labels


def test__window_labels__stream__equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    late = events.agg(F.max("ts")).first()[0] + timedelta(days=9)
    spark.createDataFrame([(late, -1, 0.0)], events.schema).write.mode("append").parquet(str(tmp_path / "in"))  # closes the windows before it
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = window_labels(stream, "ts", "user_id", timedelta(days=3), late="90 days", value_col="value")
    query = (
        rows.writeStream.outputMode("update").format("memory").queryName("tm_windows").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    last = {(r.timestamp, r.user_id): r.n for r in spark.table("tm_windows").groupBy("timestamp", "user_id").agg(F.max("n").alias("n")).collect()}
    want = {(r.timestamp, r.user_id): r.n for r in window_labels(events, "ts", "user_id", timedelta(days=3), value_col="value").collect()}
    assert {k: n for k, n in last.items() if k[1] != -1} == want and len(want) > 10
