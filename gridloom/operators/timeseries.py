"""Time series: resampling, joining and aggregating."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def seconds(rule: str) -> int:
    """Seconds of a rule such as 15, 15s, 5m or 1h."""
    m = re.fullmatch(r"\s*(\d+)\s*([smh]?)\s*", rule)
    if not m or int(m[1]) <= 0:
        raise ValueError(f"rule {rule!r} is not a positive number of s, m or h")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600}[m[2]]


def resample(df: DataFrame, rule: str, timestamp: str = "timestamp", value: str = "value") -> DataFrame:
    """count, mean, min and max of the values in each bucket of the rule's length; rows with either null are left out."""
    period = seconds(rule)
    d = df.select(F.col(timestamp).cast("long").alias("t"), F.col(value).cast("double").alias("v")).dropna()
    return d.groupBy((F.col("t") - F.pmod("t", F.lit(period).cast("long"))).alias("bucket_start")).agg(F.count("*").alias("count"), F.avg("v").alias("mean_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))


def outer_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join with one key column; the right side's clashing columns get the suffix _right."""
    clash = [c for c in right.columns if c in left.columns and c != on]
    return left.join(right.withColumnsRenamed({c: f"{c}_right" for c in clash}), on, "full_outer")


def aggregate(df: DataFrame, group: str = "sensor", value: str = "value", agg: str = "sum") -> DataFrame:
    """One row a group with the column value_agg; count counts rows, nulls included."""
    if agg == "count":
        return df.groupBy(group).agg(F.count(F.lit(1)).alias(f"{value}_count"))
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; use count, {', '.join(AGGREGATES)}")
    return df.groupBy(group).agg(AGGREGATES[agg](F.col(value).cast("double")).alias(f"{value}_{agg}"))
