"""Ratings: their statistics, errors and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clipped


def rating_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def rmse(rows: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row: the root mean squared error of (prediction, truth); predictions clipped to the domain if it is given."""
    p = F.col("prediction")
    if low is not None:
        p = clipped(p, F.lit(low), F.lit(high))
    return rows.agg(F.sqrt(F.avg((p - F.col("truth")) * (p - F.col("truth")))).alias("rmse"))


def losses(rows: DataFrame, weight: float) -> DataFrame:
    """One row: half the mean squared rating error, the mean squared reconstruction error, and their weighted sum."""
    rating = F.avg((F.col("prediction") - F.col("truth")) * (F.col("prediction") - F.col("truth"))) / 2
    rebuilt = F.avg("reconstruction")
    return rows.agg(rating.alias("rating_loss"), rebuilt.alias("reconstruction_loss"), (rating + weight * rebuilt).alias("loss"))


def global_norm(parameters: DataFrame, most: float | None = None) -> DataFrame:
    """One row: the L2 norm over (name, i, value), and the factor that clips it to `most`."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")))
    return parameters.agg(norm.alias("norm"), (F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(most), norm), F.lit(1.0))) if most else F.lit(1.0)).alias("factor"))


def parameter_inventory(parameters: DataFrame) -> DataFrame:
    return parameters.groupBy("name").agg(F.count("*").alias("size"))
