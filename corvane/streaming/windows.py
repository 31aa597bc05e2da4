"""Streaming counterparts over event streams. They go beyond the batch operators: counts by tumbling and session windows, and the last row of each key."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total; rows later than the watermark are left out, and their state is dropped."""
    held = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return held.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, stop, n of runs of events with no longer pause than gap."""
    held = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return held.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
