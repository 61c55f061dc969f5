"""An extension beside the batch engine: bars from a stream of events, by tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events that arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def stream_bars(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, ticker (the event type), open, high, low, close, volume of each window; rows later than ``late`` are too late."""
    order = F.struct("ts", "event_id")
    rows = events.filter("value is not null").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length).alias("w"), F.col("event_type").alias("ticker")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    ).select(F.col("w.start").alias("start"), "ticker", "open", "high", "low", "close", "volume")
