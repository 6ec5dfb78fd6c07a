"""Counts of an event stream by time window and type, with late rows up to a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, end, kind, n): works alike on a table and on a stream, where rows later than ``late`` are left out."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def count_to_parquet(events: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append finished windows to a Parquet table; runs over what is there and ends."""
    out = windowed_counts(events, **options).writeStream.outputMode("append").format("parquet")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
