"""Sharding by a minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import saved, text_or_empty, unused

#: Buckets of the documents of a shard for numbering them, and of the groups of one size where a cut falls.
BUCKETS = 4096


def minimax_cuts(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Cuts (class, rank) of a run-length coded sequence of atomic groups, one for each further shard.

    The sequence holds counts[i] groups of sizes[i], class after class. The smallest capacity under which a greedy
    filling needs no more than the shards left is found by binary search; the shard is cut there,
    and the rest is solved again for the shards left, so that one giant group doesn't leave later shards empty.
    """
    ends = np.concatenate([[0], np.cumsum(sizes * counts)])
    ranks = np.concatenate([[0], np.cumsum(counts)])
    total, last = int(ends[-1]), int(ranks[-1])

    def fill(done: int, capacity: int) -> tuple[int, int]:
        """Prefix sum and rank after one more shard is filled from prefix sum `done`."""
        k = int(np.searchsorted(ends, done + capacity, "right")) - 1
        if k >= len(sizes):
            return total, last
        more = (done + capacity - int(ends[k])) // int(sizes[k])
        return int(ends[k]) + more * int(sizes[k]), int(ranks[k]) + more

    def feasible(done: int, capacity: int, left: int) -> bool:
        for _ in range(left):
            if done >= total:
                break
            done = fill(done, capacity)[0]
        return done >= total

    cuts, done = [], 0
    for left in range(shards, 1, -1):
        at = int(np.searchsorted(ends, done, "right")) - 1
        low = max(int(sizes[at]) if at < len(sizes) else 0, -((done - total) // left)) - 1
        high = total - done
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if feasible(done, mid, left) else (mid, high)
        done, rank = fill(done, high)
        k = min(int(np.searchsorted(ranks, rank, "right")) - 1, len(sizes))
        cuts.append((k, rank - int(ranks[k])))
    return cuts


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deal documents into shards of near equal bytes; equal texts stay together.

    Takes doc_id and text; other columns are ignored. Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law
    (`bytes`), shard, slot (gapless from 0 in each shard), grown_shard (null under this law). A null text counts as
    empty and shares the group of empty texts; repeated rows each get a slot; an empty table gives no rows; with fewer
    groups than shards the last shards stay empty.

    Groups stand in the order of falling size, ties by digest. In that order the sequence is known from its histogram of
    sizes, and a histogram of d different sizes needs at least d * (d + 1) / 2 bytes of text: the driver gets at most
    sqrt(2 * bytes) rows. A cut inside one size becomes a bound on the digest, so that a group's
    shard is an expression over its size and digest.
    """
    rows = saved(docs.select("doc_id", text_or_empty().alias("t")).select("doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"), F.md5(F.encode("t", "UTF-8")).alias("digest")))
    groups = saved(rows.groupBy("digest", "size").agg(F.count("*").alias("n")).select("digest", "n", (F.col("size") * F.col("n")).alias("group_size")))
    runs = groups.groupBy("group_size").agg(F.count("*").alias("n")).orderBy(F.desc("group_size")).toPandas()
    sizes, counts = runs["group_size"].to_numpy(np.int64), runs["n"].to_numpy(np.int64)
    shard = F.lit(0)
    for k, rank in minimax_cuts(sizes, counts, shards) if len(sizes) else []:
        if k >= len(sizes):
            continue
        at = int(sizes[k])
        after = F.col("group_size") < at
        shard = shard + F.when(after | ((F.col("group_size") == at) & (F.col("digest") >= digest_of_rank(groups, at, rank))), 1).otherwise(0)
    many = groups.where("n > 1").select("digest", F.col("group_size").alias("of_group"))
    placed = saved(rows.join(many, "digest", "left").withColumn("group_size", F.coalesce("of_group", "size")).select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")))
    before = W.Window.partitionBy("shard").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    # One row for each shard and bucket: at most shards * BUCKETS.
    first = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    slot = (F.col("first") + within - 1).cast("long").alias("slot")
    return placed.join(F.broadcast(first), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def digest_of_rank(groups: DataFrame, size: int, rank: int) -> str:
    """The digest at a rank, from 0, among the groups of one size. Counts by digest prefix lead to one prefix, whose few groups are then ordered."""
    if rank == 0:
        return ""
    same = groups.where(F.col("group_size") == size).withColumn("prefix", F.substring("digest", 1, 3))
    for row in same.groupBy("prefix").count().orderBy("prefix").collect():
        if rank < row["count"]:
            return same.where(F.col("prefix") == row["prefix"]).orderBy("digest").limit(rank + 1).agg(F.max("digest")).first()[0]
        rank -= row["count"]
    return "~"


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, and the shard and slot that shard_documents() gives them; a column that is
    called like one of these keeps its name, and the new one gets an underscore."""
    placed = saved(shard_documents(docs, shards))
    key, number, shard, slot = (unused(docs, c) for c in ("key", "number", "shard", "slot"))
    # Rows that share a doc_id are numbered alike on both sides. The numbers are compared outside the key, so that texts move once.
    window = lambda *order: F.row_number().over(W.Window.partitionBy(key).orderBy("doc_id", *order))
    left = docs.withColumn(key, F.xxhash64("doc_id")).withColumn(number, window(F.crc32(F.encode(text_or_empty(), "UTF-8"))))
    right = placed.withColumn(key, F.xxhash64("doc_id")).withColumn(number, window("text_crc32", "slot"))
    right = right.select(F.col(key).alias(f"{key}_of"), F.col(number).alias(f"{number}_of"), F.col("shard").alias(shard), F.col("slot").alias(slot))
    same = (F.col(key) == F.col(f"{key}_of")) & (F.col(number) - F.col(f"{number}_of") == 0)
    return left.join(right, same).drop(key, number, f"{key}_of", f"{number}_of")
