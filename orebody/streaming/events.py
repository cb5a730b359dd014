"""Windows over an event stream, the same for a bounded table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total); on a stream, windows close ``late`` behind the newest event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, n) of runs of a user's events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")


def stream_windows(spark: SparkSession, path: str, schema, out: str, checkpoint: str, size: str = "1 day", late: str = "1 day"):
    """A query that reads new files of a folder and appends closed windows as Parquet."""
    events = spark.readStream.schema(schema).parquet(path)
    return windowed(events, size, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
