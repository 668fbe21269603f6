"""Daily event features, the same plan for a batch table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_features(events: DataFrame, late: str = "2 days") -> DataFrame:
    """``user_id, day, n, value_mean, value_min``. On a stream, a day is final once the watermark of ``late`` has passed its end."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    by = events.groupBy("user_id", F.window("ts", "1 day").alias("w"))
    out = by.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value_mean"), F.min("value").alias("value_min"))
    return out.select("user_id", F.to_date("w.start").alias("day"), "n", "value_mean", "value_min")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is now and stop; files and offsets make restarts exactly-once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
