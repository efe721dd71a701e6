"""Incremental bars and history: an extension, as the batch engine has no streams.

Trades that arrive late by more than the watermark are dropped from their bar; history is merged batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import tracking
from barloom.sources.tables import read_state


def event_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of each event type's values by tumbling event-time windows, from a stream or a table of events."""
    at = F.struct("ts", "event_id")
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.col("event_type").alias("security_code"), F.window("ts", width).alias("w"))
    bars = w.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("security_code", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def history_sink(spark: SparkSession, home: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts scan rows into versions of the recommendation history; a batch that is
    run again writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        before = read_state(spark, f"{home}/v{number:06d}", tracking.HISTORY)
        tracking.upsert(before, batch).write.mode("overwrite").parquet(f"{home}/v{number + 1:06d}")

    return merge


__all__ = ["event_bars", "history_sink"]
