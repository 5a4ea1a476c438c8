"""Streaming forms of the time operators: tumbling and session windows with watermarks over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum by window and type; events later than ``late`` are dropped by the watermark."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events with no gap of that length."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n"))
