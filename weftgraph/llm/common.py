"""What the operators of this package share: tables, scratch tables, connected components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space ends a word; every other character belongs to one.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch where the session doesn't set them: whole texts at Spark's 10,000 rows take tens of MB on both sides.
BATCH = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that they needn't have it installed; set the session's batches to BATCH rows where they are left at Spark's default."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH)
    sc = spark.sparkContext
    if not getattr(sc, "_weftgraph_sent", False):
        top = Path(__file__).parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/weftgraph", "zip", top, "weftgraph"))
        sc._weftgraph_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a local one only where none is set."""
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


#: For file: paths, which other file systems ignore. Where Hadoop's native code is missing, it starts a chmod process for each local folder, file and sum of checks that
#: it makes; until such a process runs its own program it counts as a second executor. So scratch files have no sums beside them; Parquet's own page checksums are verified.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a file where a bound on a table's rows is known, and there are more files than cores.
FILE = 1 << 14


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors, is computed once.

    rows: about as many as the table has at most, where what it is made from is about as small; small tables then come in few files, made by as few tasks, whatever the number of partitions.
    All rows are written, whether or not there are more.
    """
    path, spark = scratch(df.sparkSession), df.sparkSession
    if rows is not None:
        df = df.coalesce(max(2, spark.sparkContext.defaultParallelism, -(-rows // FILE)))
    # A session's own choice of a file system stays.
    plain = _PLAIN if spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") is None else {}
    df.write.options(**plain, **{"parquet.page.write-checksum.enabled": "true"}).parquet(path)
    found = spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    found._scratch = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Removes what saved() wrote for tables that nothing reads any more; other tables stay."""
    for t in tables:
        if path := t.__dict__.pop("_scratch", None):
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.Table], list[np.ndarray]], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, or of one larger group, from batches in which rows of equal keys stand together; no group is divided."""
    rest: list[pa.RecordBatch] = []
    held, enough = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        held += batch.num_rows
        if held < enough:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        changes = np.zeros(table.num_rows - 1, bool)
        for key in keys(table):
            changes |= key[1:] != key[:-1]
        if changes.any():
            cut = int(np.flatnonzero(changes)[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        rest = table.to_batches()
        # A group that outgrows `rows` is looked through again only after it has doubled.
        held, enough = table.num_rows, max(rows, 2 * table.num_rows)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _stars(edges: DataFrame) -> bool:
    """Whether the distinct edges (a, b), a > b, are stars already: no node has two smaller neighbours, or one smaller and one larger."""
    ends = edges.select(F.col("a").alias("id"), F.lit(2).alias("n")).unionByName(edges.select(F.col("b").alias("id"), F.lit(1).alias("n")).distinct())
    return ends.groupBy("id").agg(F.sum("n").alias("n")).where("n > 2").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b) of longs: rows (id, component_id), component_id the smallest id reached.

    Alternates large and small stars until only stars are left, in a number of rounds that grows with the logarithm of a
    component's size. A hub's minimum is pre-aggregated and saved before it is joined, so that the join
    reads plain exchanges, whose hot keys adaptive execution splits. No round has more edges than the first. Self-loops keep lone ids.
    """
    loops = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    work = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = work.count()
    while not _stars(work):
        # Large star: every larger neighbour of a node is tied to the least of the node and its neighbours.
        both = work.select("a", "b").unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), n)
        large = saved(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)
        # Small star: a node and its smaller neighbours are tied to the least of them.
        dropped(work, least)
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), n)
        tied = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        work = saved(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), n)
        dropped(large, least)
    found = work.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return loops.join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
