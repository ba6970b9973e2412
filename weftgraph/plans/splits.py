"""Train, validation and test splits, batches and masks, all by ranks of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.graph import induced, remove_edges, running
from ..operators.sampling import rank_key


def ranked(rows: DataFrame, seed: int | str, *keys: str) -> DataFrame:
    """Rows with their rank from 1 in the order of a digest.

    The digest's first four digits deal rows into 65,536 ordered parts that are ranked side by side; the parts' counts give their first ranks.
    """
    marked = rows.withColumn("_key", rank_key(seed, *keys)).withColumn("_part", F.substring("_key", 1, 4))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.Window.partitionBy("_part").orderBy("_key", *keys))
    # At most 65,536 rows are broadcast.
    return marked.withColumn("_within", within).join(F.broadcast(first), "_part").withColumn("rank", F.col("_first") + F.col("_within")).drop("_key", "_part", "_within", "_first")


def transductive(edges: DataFrame, test: float, valid: float, seed: int = 0) -> DataFrame:
    """Edges with a split: ceil(n * test) are test, ceil(rest * valid) of the rest validation, others train."""
    n = edges.count()
    n_test = -int(-n * test // 1)
    n_valid = -int(-(n - n_test) * valid // 1)
    split = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_valid, "valid").otherwise("train")
    return ranked(edges, seed, "src", "dst").withColumn("split", split).drop("rank")


def inductive_nodes(degrees: DataFrame, percent: int, seed: int = 0, least: int = 10) -> DataFrame:
    """(id, degree, held): nodes in random order are held out if their degree exceeds `least`, until ceil(n * percent / 100) are."""
    target = -(-degrees.count() * percent // 100)
    many = ranked(degrees.where(F.col("degree") > least), seed, "id")
    return degrees.join(many.select(F.col("id").alias("_id"), "rank"), F.col("id") == F.col("_id"), "left").select("id", "degree", F.coalesce(F.col("rank") <= target, F.lit(False)).alias("held"))


def inductive_edges(edges: DataFrame, nodes: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """Edges of held nodes (src) that become test pairs: floor(degree * percent / 100) of each."""
    held = nodes.where("held").select(F.col("id").alias("src"), F.floor(F.col("degree") * percent / 100).alias("_most"))
    rank = F.row_number().over(W.Window.partitionBy("src").orderBy(rank_key(seed, "src", "dst"), "dst"))
    return edges.join(held, "src").withColumn("_rank", rank).where("_rank <= _most").drop("_rank", "_most")


def split_graphs(edges: DataFrame) -> dict[str, DataFrame]:
    """From edges with a split: the test graph lacks test pairs, the train and validation graphs lack validation pairs too."""
    test = edges.where("split <> 'test'")
    return {"all": edges, "test": test, "valid": test.where("split <> 'valid'"), "train": test.where("split <> 'valid'")}


def inductive_graphs(edges: DataFrame, train_ids: DataFrame, valid_ids: DataFrame, valid_pairs: DataFrame) -> dict[str, DataFrame]:
    """The validation graph spans train and validation nodes without validation pairs, the train graph train nodes alone."""
    seen = train_ids.select("id").unionByName(valid_ids.select("id"))
    return {"valid": remove_edges(induced(edges, seen), valid_pairs), "train": induced(edges, train_ids)}


def batches(pairs: DataFrame, size: int, sequential: bool = True, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Pairs with a batch number: slices of their order, or of a random order that each epoch deals anew; size -1 is one batch."""
    if size < 0:
        return pairs.withColumn("batch", F.lit(0).cast("long"))
    if sequential:
        # First places come from sums over nodes; pairs are ranked within their src.
        counts = pairs.groupBy("src").agg(F.count("*").alias("_n"))
        first = running(counts, "src", F.col("_n"), "_first").drop("_n")
        place = F.col("_first") + F.row_number().over(W.Window.partitionBy("src").orderBy("dst"))
        return pairs.join(first, "src").withColumn("batch", F.floor((place - 1) / size)).drop("_first")
    return ranked(pairs, f"{seed}/{epoch}", "src", "dst").withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def reconstruction_mask(nodes: DataFrame, share: float, zero: float, seed: int = 0) -> DataFrame:
    """(id, chosen, mapped): ceil(share * n) nodes are chosen; of these the share `zero` is masked (null), the others map to themselves."""
    most = -int(-nodes.count() * share // 1)
    chosen = F.col("rank") <= most
    coin = F.conv(F.substring(rank_key(f"{seed}/mask", "id"), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return ranked(nodes.select("id"), seed, "id").select("id", chosen.alias("chosen"), F.when(~(chosen & (coin < zero)), F.col("id")).alias("mapped"))


def evaluation_map(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(id, mapped): training nodes map to themselves, others to null."""
    return nodes.select("id").join(known.select("id", F.col("id").alias("mapped")), "id", "left")


def split_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("split").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))
