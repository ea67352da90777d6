"""Event-time windows on streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_event_time(events: DataFrame) -> DataFrame:
    """`ts` as a timestamp that watermarks accept."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, folder: str, schema, max_files: int = 1) -> DataFrame:  # noqa: ANN001
    """A stream over the Parquet files of a folder."""
    return with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder))


def tumbling(events: DataFrame, length: str = "1 day", delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of windows side by side."""
    return sliding(events, length, length, delay)


def sliding(events: DataFrame, length: str = "2 days", step: str = "1 day", delay: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of overlapping windows."""
    source = events.withWatermark("ts", delay) if delay else events
    out = source.groupBy(F.window("ts", length, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause as long as `gap`."""
    source = events.withWatermark("ts", delay) if delay else events
    out = source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
