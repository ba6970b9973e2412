"""Sampling made repeatable: rows are ranked by a digest of a seed and their keys, ties by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .graph import index_of, with_support


def rank_key(seed: int | str, *keys: str) -> Column:
    """A digest that orders rows at random, the same for the same seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def draw(seed: int | str, *keys: str, below: Column | int) -> Column:
    """A number from 0 up to `below`, the same for the same seed and keys: 48 bits of the digest, modulo."""
    below = below if isinstance(below, Column) else F.lit(below)
    return F.pmod(F.conv(F.substring(rank_key(seed, *keys), 1, 12), 16, 10).cast("long"), below)


def sample_neighbors(edges: DataFrame, k: int | Column, seed: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """At most k edges of each selected src, without replacement; a negative k takes all, without ranking."""
    if ids is not None:
        edges = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    if isinstance(k, int) and k < 0:
        return edges
    rank = F.row_number().over(W.Window.partitionBy("src").orderBy(rank_key(seed, "src", "dst"), "dst"))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sample_submatrix(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A sample of edges over columns that are numbered anew: those no sampled edge reaches are dropped."""
    chosen = sample_neighbors(edges, k, seed)
    cols = index_of(chosen.select(F.col("dst").alias("id")).distinct())
    return chosen.join(cols.select(F.col("id").alias("dst"), F.col("ind").alias("dst_ind")), "dst")


def sample_with_support(edges: DataFrame, k: int, seed: int = 0, symmetric: bool = True) -> DataFrame:
    """Sampled edges with the support they have in the full graph."""
    return sample_neighbors(with_support(edges, symmetric), k, seed)


def sample_and_merge(edges: DataFrame, seeds: DataFrame, fraction: float, least: int, seed: int = 0) -> DataFrame:
    """Seeds and the sampled neighbours of each, as one distinct list (id, ind): max(round(degree * fraction), least) a seed."""
    chosen = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    count = chosen.groupBy("src").agg(F.greatest(F.round(F.count("*") * F.lit(fraction)), F.lit(least)).alias("_most"))
    rank = F.row_number().over(W.Window.partitionBy("src").orderBy(rank_key(seed, "src", "dst"), "dst"))
    near = chosen.join(count, "src").withColumn("_rank", rank).where("_rank <= _most").select(F.col("dst").alias("id"))
    return index_of(seeds.select("id").unionByName(near).distinct())


def choices(rows: DataFrame, k: int, size: Column, seed: int = 0, replace: bool = True) -> DataFrame:
    """k draws from 0..size-1 for each row (key): (key, draw, value); without replacement by ranking the range, at most size."""
    if replace:
        drawn = rows.withColumn("_n", size).where("_n > 0").select("key", "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"))
        return drawn.select("key", "draw", draw(seed, "key", "draw", below=F.col("_n")).alias("value"))
    spread = rows.withColumn("_n", size).where("_n > 0").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).alias("value"))
    rank = F.row_number().over(W.Window.partitionBy("key").orderBy(rank_key(seed, "key", "value"), "value"))
    return spread.withColumn("draw", rank - 1).where(F.col("draw") < k).select("key", "draw", "value")


def negatives(edges: DataFrame, targets: DataFrame, candidates: int, wanted: Column, seed: int = 0) -> DataFrame:
    """(id, other): for each target (id, degree) distinct non-neighbours among 0..candidates-1, ceil(wanted) of them or all there are.

    Each target draws two numbers for each one it wants, and 16 more; repeats and neighbours go, the first drawn stay. A target
    that is then short, whose row is nearly full, takes its whole complement in the order of a digest. The
    product of targets and candidates is formed for no others.
    """
    need = targets.withColumn("_want", F.least(F.ceil(wanted), F.lit(candidates) - F.col("degree")).cast("long"))
    tries = need.where("_want > 0").select("id", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("_want") + 15)).alias("_try"))
    drawn = tries.select("id", "_try", draw(seed, "id", "_try", below=candidates).alias("other")).groupBy("id", "other").agg(F.min("_try").alias("_try"))
    known = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    fresh = drawn.join(known, ["id", "other"], "left_anti")
    counted = fresh.groupBy("id").agg(F.count("*").alias("_have"))
    short = need.join(counted, "id", "left").where(F.coalesce("_have", F.lit(0)) < F.col("_want")).select("id")
    rest = short.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(candidates - 1).cast("long"))).alias("other")).join(known, ["id", "other"], "left_anti").withColumn("_try", F.lit(0).cast("long"))
    every = fresh.join(short, "id", "left_anti").select("id", "other", "_try").unionByName(rest)
    rank = F.row_number().over(W.Window.partitionBy("id").orderBy("_try", rank_key(seed, "id", "other"), "other"))
    return every.withColumn("_rank", rank).join(need.select("id", "_want"), "id").where("_rank <= _want").select("id", "other")


def labelled_pairs(edges: DataFrame, targets: DataFrame, candidates: int, wanted: Column, seed: int = 0) -> DataFrame:
    """(id, other, label): each target's edges with label 1 and its negatives() with label 0."""
    known = edges.join(targets.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("label"))
    return known.unionByName(negatives(edges, targets, candidates, wanted, seed).withColumn("label", F.lit(0)))


def negatives_same_node(edges: DataFrame, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """One non-edge for each edge (src, dst, new_src, new_dst): a coin keeps its row or its column and the other end is drawn anew.

    Eight draws an edge, the first that is no edge; an edge whose draws all fail takes draws over the whole graph, until each edge has one.
    """
    coin = draw(f"{seed}/coin", "src", "dst", below=2)
    col, row = draw(f"{seed}/col", "src", "dst", "_try", below=cols), draw(f"{seed}/row", "src", "dst", "_try", below=rows)
    free = F.col("_try") >= 8

    def first_of(left: DataFrame, low: int, high: int) -> DataFrame:
        tries = left.select("src", "dst", coin.alias("_coin"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_try"))
        drawn = tries.select("src", "dst", "_try", F.when(free | (F.col("_coin") == 1), row).otherwise(F.col("src")).alias("new_src"), F.when(free | (F.col("_coin") == 0), col).otherwise(F.col("dst")).alias("new_dst"))
        fresh = drawn.join(edges.select(F.col("src").alias("new_src"), F.col("dst").alias("new_dst")), ["new_src", "new_dst"], "left_anti")
        return fresh.groupBy("src", "dst").agg(F.min(F.struct("_try", "new_src", "new_dst")).alias("x")).select("src", "dst", "x.new_src", "x.new_dst")

    # In a sparse graph one draw serves nearly every edge; the others are drawn only for those it fails.
    found = first_of(edges, 0, 0)
    found = found.unionByName(first_of(edges.join(found, ["src", "dst"], "left_anti"), 1, 23))
    low, high = 24, 192
    while rows * cols > edges.count() and not (left := edges.join(found, ["src", "dst"], "left_anti")).isEmpty():
        found = found.unionByName(first_of(left, low, high))
        low, high = high + 1, 8 * high
    return found


def negatives_all(edges: DataFrame, rows: int, cols: int, n: int, seed: int = 0) -> DataFrame:
    """n non-edges (draw, src, dst), uniform with replacement: the draws that hit an edge are dropped, which keeps the rest uniform.

    Where too few are left, more are drawn; a graph that lacks no edge has none to give.
    """
    draws = 2 * n + 64
    while True:
        drawn = edges.sparkSession.range(draws).select(F.col("id").alias("draw"))
        drawn = drawn.select("draw", draw(f"{seed}/row", "draw", below=rows).alias("src"), draw(f"{seed}/col", "draw", below=cols).alias("dst"))
        free = drawn.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        if free.limit(n).count() == n or rows * cols <= edges.count():
            return free.orderBy("draw").limit(n).select("draw", "src", "dst")
        draws *= 4


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 0, back: float = 0.0) -> DataFrame:
    """(walk, step, node): walks along edges from (walk, node); with the probability `back` a step returns to the start.

    Each node's neighbours are numbered once; a step is one join of all walks on the neighbour number drawn, and a walk carries
    its path. It ends at a node without neighbours.
    """
    numbered = edges.select("src", "dst", (F.row_number().over(W.Window.partitionBy("src").orderBy("dst")) - 1).alias("_at"))
    counted = edges.groupBy("src").agg(F.count("*").alias("_n"))
    now = starts.select("walk", F.col("node").alias("_start"), "node", F.array("node").alias("_path"))
    for step in range(1, length + 1):
        moved = now.join(counted.withColumnRenamed("src", "node"), "node", "left").withColumn("_s", F.lit(step))
        pick = draw(f"{seed}/move", "walk", "_s", below=F.col("_n"))
        home = F.col("_n").isNotNull() & (draw(f"{seed}/back", "walk", "_s", below=1_000_000) < int(back * 1_000_000))
        moved = moved.select("walk", "_start", "node", "_path", home.alias("_home"), F.when(~home, pick).alias("_at"))
        to = F.when(F.col("_home"), F.col("_start")).otherwise(F.col("dst"))
        moved = moved.join(numbered.withColumnRenamed("src", "node"), ["node", "_at"], "left").withColumn("_to", to)
        now = moved.select("walk", "_start", F.coalesce("_to", "node").alias("node"), F.when(F.col("_to").isNull(), F.col("_path")).otherwise(F.array_append("_path", F.col("_to"))).alias("_path"))
    return now.select("walk", F.posexplode("_path").alias("step", "node"))


def capped_nodes(visits: DataFrame, most: int) -> DataFrame:
    """The first `most` different nodes of each walk, by the step of their first visit."""
    first = visits.groupBy("walk", "node").agg(F.min("step").alias("step"))
    rank = F.row_number().over(W.Window.partitionBy("walk").orderBy("step", "node"))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
