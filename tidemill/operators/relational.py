"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Each left row with the latest right value at or before its time: one union, one exchange, one running last.

    At equal times the right row counts as earlier.
    """
    cols = left.columns
    a = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*(F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with all ranges that hold them (low <= point < high), by an equi-join on bins of ``width``."""
    p = points.withColumn("_bin", F.floor(F.col(point) / F.lit(width)))
    first, last = F.floor(F.col(low) / F.lit(width)), F.floor(F.col(high) / F.lit(width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(first, last)))
    return p.join(r, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """``(key, start, end, events)`` of runs of events with no gap longer than ``gap_seconds``."""
    s = events.groupBy(key, F.session_window(at, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("events"), F.min(at).alias("start"), F.max(at).alias("end"))
    return s.select(key, "start", "end", "events")


def share_of(value: Column, *by: str) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*by))
