from pyspark.sql import functions as F

from chronofold.streaming import lookback


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    lookback.run_to(lookback.daily_counts(lookback.event_stream(spark, folder)), f"{tmp_path}/out", f"{tmp_path}/state")
    latest = lookback.current(spark, f"{tmp_path}/out")
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.user_id, r.day): r.n for r in lookback.daily_counts(events).collect()}
    assert {(r.user_id, r.day): r.n for r in latest.collect()} == want and want


def test_windows_that_several_batches_change(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(3):  # every window gets events from each file
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = lookback.event_stream(spark, f"{tmp_path}/in", "*.parquet", files=1)
    lookback.run_to(lookback.daily_counts(stream, late="90 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    written = spark.read.parquet(f"{tmp_path}/out")
    got = lookback.current(spark, f"{tmp_path}/out")
    want = lookback.daily_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    rows = lambda df: {(r.user_id, r.day): (r.n, round(r.value, 6)) for r in df.collect()}
    assert written.select("batch").distinct().count() == 3 and written.count() > got.count() and rows(got) == rows(want)
