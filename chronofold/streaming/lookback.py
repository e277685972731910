"""Beyond the batch programs: daily look-back aggregates kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 8) -> DataFrame:
    """The events of a folder as a stream of at most `files` files at a time; times as instants, which watermarks need.

    name: a file's name, or a pattern of several.
    """
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days", days: int = 7) -> DataFrame:
    """(user_id, day, n, value): events of the `days` days that end with `day`, by sliding windows under a watermark."""
    window = F.window("ts", f"{days} days", "1 day")
    counted = events.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n"),
        F.sum("value").alias("value"))
    return counted.select("user_id", F.col("w.end").alias("day"), "n", "value")


def run_to(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Write what the stream holds now as Parquet, a folder for each batch; a restart goes on from the checkpoint.

    A batch holds the windows that it changed, with their new totals; `current` reads the last word on each.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation",
        checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(user_id, day, n, value): of each window, what the latest batch that changed it says."""
    every = spark.read.parquet(out)
    newest = F.max_by(F.struct("n", "value"), "batch").alias("x")
    return every.groupBy("user_id", "day").agg(newest).select("user_id", "day", "x.n", "x.value")
