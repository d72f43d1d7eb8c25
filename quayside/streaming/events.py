"""Hourly tumbling counts of events, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n, total: late is the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events  # a watermark needs a time zone
    g = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str, schema, late: str = "2 hours") -> DataFrame:
    return hourly(spark.readStream.schema(schema).parquet(folder), late)
