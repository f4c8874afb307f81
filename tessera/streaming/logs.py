"""Windows over the event log; each takes a batch or a streaming DataFrame with ts (give a stream a watermark first)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str, delay: str) -> DataFrame:
    """Drops repeated keys that arrive within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def count_stream(events: DataFrame, width: str, delay: str, path: str, checkpoint: str):
    """Writes closed windows of a stream as Parquet; late rows within the delay still count."""
    counted = tumbling(events.withWatermark("ts", delay), width)
    return counted.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(events: DataFrame, key: str, width: str, delay: str, path: str, checkpoint: str) -> DataFrame:
    """Counts what a stream of events has now, each key once, and goes on from its checkpoint when called again: the closed windows written so far.

    A window is closed, and written once, when an event later than its end plus the delay has been seen. Repeated keys within the delay
    count once, rows later than the delay don't count. All files that have arrived are read in this call (trigger availableNow).
    """
    spark = events.sparkSession
    counted = tumbling(once(events, key, delay), width)
    query = counted.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(path)
