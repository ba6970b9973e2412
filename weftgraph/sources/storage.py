"""Graphs on disk: Parquet directories, text edges, coordinate lists; metric rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_relation(path: str, edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, types: DataFrame | None = None) -> None:
    for name, df in {"edges": edges, "src_nodes": src_nodes, "dst_nodes": dst_nodes, "link_types": types}.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_relation(spark: SparkSession, path: str, typed: bool = False) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("edges", "src_nodes", "dst_nodes", *(["link_types"] if typed else []))}


def short_number(x: Column) -> Column:
    """A number as C's %g writes it: six significant digits without trailing zeros, with an exponent below 1e-4 and from 1e6 on."""
    x = x.cast("double")
    long = F.format_string("%.5e", x)
    power = F.regexp_extract(long, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda digits: F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    found = F.concat(bare(F.substring_index(long, "e", 1)), F.lit("e"), F.substring_index(long, "e", -1))
    for k in range(-4, 6):
        found = F.when(power == k, bare(F.format_string(f"%.{5 - k}f", x))).otherwise(found)
    return found


def write_edges_text(edges: DataFrame, path: str) -> None:
    """Tab-separated src, dst and value, one edge a line."""
    edges.select("src", "dst", short_number(F.col("value"))).write.mode("overwrite").option("sep", "\t").csv(path)


def read_edges_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src long, dst long, value double").option("sep", "\t").csv(path)


def append_metrics(spark: SparkSession, path: str, rows: list[dict[str, float]]) -> None:
    """Add metric rows to a Parquet table: one row for each value, with its step in the order of `rows` after the steps that are there.

    Names may differ from row to row; a table that isn't there yet begins with step 0.
    """
    try:
        begin = (read_metrics(spark, path).agg(F.max("step")).first()[0] or 0) + 1
    except AnalysisException:
        begin = 0
    values = [(begin + k, name, float(value)) for k, row in enumerate(rows) for name, value in row.items()]
    spark.createDataFrame(values, "step long, metric string, value double").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("step long, metric string, value double").parquet(path)
