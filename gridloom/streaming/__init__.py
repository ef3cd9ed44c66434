"""Streaming forms of the batch operators; an extension of what the batch tables offer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", value: str = "value") -> DataFrame:
    """count, mean, min and max by tumbling window; events later than the watermark are left out."""
    d = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return d.agg(F.count("*").alias("count"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value")).select(F.col("w.start").alias("bucket_start"), "count", "mean_value", "min_value", "max_value")
