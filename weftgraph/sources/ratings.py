"""Delimited rating, user and item files of three public rating sets, without headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import genre_flags

#: Layouts by set: separator, columns of users and items. Fixed values.
LAYOUTS = {
    "ml-100k": {"sep": "|", "ratings_sep": "\t", "users": "user_id long, age int, gender string, occupation string, zip_code string"},
    "ml-1m": {"sep": "::", "ratings_sep": "::", "users": "user_id long, gender string, age int, occupation string, zip_code string"},
    "ml-10m": {"sep": "::", "ratings_sep": "::", "users": None},
}
RATINGS = "user_id long, item_id long, rating float, timestamp long"


def _layout(name: str) -> dict:
    if name not in LAYOUTS:
        raise ValueError(f"unknown data set {name!r}; known are {sorted(LAYOUTS)}")
    return LAYOUTS[name]


def read_ratings(spark: SparkSession, path: str | list[str], name: str = "ml-100k") -> DataFrame:
    """Rows of one file, or of several one after the other (a published train and test part)."""
    return spark.read.schema(RATINGS).option("sep", _layout(name)["ratings_sep"]).csv(path)


def read_users(spark: SparkSession, path: str | None, name: str = "ml-100k", ratings: DataFrame | None = None) -> DataFrame:
    """Users as they are described; a set without a user file has those that rate."""
    layout = _layout(name)
    if layout["users"] is None:
        return ratings.select("user_id").distinct()
    return spark.read.schema(layout["users"]).option("sep", layout["sep"]).csv(path)


def read_items(spark: SparkSession, path: str, genres: list[str], name: str = "ml-100k") -> DataFrame:
    """(item_id, title, flags): one flag a genre, from columns of their own or from a joined list."""
    layout = _layout(name)
    if name == "ml-100k":
        flags = ", ".join(f"g{i} int" for i in range(len(genres)))
        rows = spark.read.schema(f"item_id long, title string, release_date string, video_release_date string, url string, {flags}").option("sep", "|").csv(path)
        return rows.select("item_id", "title", F.array(*[f"g{i}" for i in range(len(genres))]).alias("flags"))
    rows = spark.read.schema("item_id long, title string, genres string").option("sep", layout["sep"]).csv(path)
    return rows.select("item_id", "title", genre_flags(F.col("genres"), genres).alias("flags"))
