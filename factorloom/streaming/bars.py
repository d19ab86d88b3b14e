"""Daily bars from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


def daily_bars(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """date, instrument, open, high, low, close, volume, amount by day and user; late events count until the watermark passes their day."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone
    seen = events.withWatermark("ts", lateness) if events.isStreaming else events
    at = F.struct("ts", "event_id")
    return (
        seen.groupBy(F.window("ts", "1 day").alias("day"), F.col("user_id").cast("string").alias("instrument"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"), F.sum("value").alias("amount"))
        .select(F.to_date("day.start").alias("date"), "instrument", "open", "high", "low", "close", "volume", "amount")
    )
