"""Keeping daily bars current from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_bars(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Daily bars per event type; a day is given out once nothing for it can still come in time."""
    key = F.struct("ts", "event_id")
    day = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    bars = day.agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume"))
    return bars.select(F.col("event_type").alias("symbol"), F.col("window.start").cast("date").alias("ts"), "open", "high", "low", "close", "volume")


def sink(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
