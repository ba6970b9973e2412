"""Table layouts of a sparse typed graph, and checks of rows against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("ind", T.IntegerType()), T.StructField("features", T.ArrayType(T.FloatType()))])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("value", T.DoubleType())])
LINK_TYPES = T.StructType([T.StructField("link_id", T.IntegerType()), T.StructField("value", T.DoubleType())])
SEGMENTS = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("seg", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())])
VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


def violations(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Counts of what breaks a graph: edge ends without a node, null ends or values, repeated edges."""
    unknown = lambda side, nodes: edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti").agg(F.count("*").alias("n"))
    parts = {
        "unknown_src": unknown("src", src_nodes),
        "unknown_dst": unknown("dst", dst_nodes),
        "nulls": edges.where("src is null or dst is null or value is null").agg(F.count("*").alias("n")),
        "repeated": edges.groupBy("src", "dst").count().where("count > 1").agg(F.count("*").alias("n")),
    }
    found = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("n"))
        found = df if found is None else found.unionByName(df)
    return found
