"""Degrees over an append-only stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_degrees(edges: DataFrame, side: str = "src", time: str | None = None, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of edges by node; with a time column, by node and window, where rows later than the watermark are dropped."""
    if time is None:
        return edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    counted = edges.withWatermark(time, late).groupBy(F.window(time, window), F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    return counted.select(F.col("window.start").alias("begin"), "id", "degree")
