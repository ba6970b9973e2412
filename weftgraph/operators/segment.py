"""Segment algebra: reductions, broadcasts, softmax and pooling over (seg, pos, value) rows, with their gradients.

A segment is the edges of one node. Segment tables list every segment, so that empty ones appear in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def reduce(data: DataFrame, segments: DataFrame, how: str = "sum", keys: tuple[str, ...] = ("seg",)) -> DataFrame:
    """One value for each segment: sum (0 if empty), avg (0), min or max (null)."""
    value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how]("value")
    reduced = data.groupBy(*keys).agg(value.alias("value"))
    out = F.coalesce("value", F.lit(0)).alias("value") if how in ("sum", "avg") else F.col("value")
    return segments.join(reduced, list(keys), "left").select(*keys, out)


def broadcast(data: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Each value of data with its segment's value of right: add, sub, mul, div (by 0 infinite, 0 by 0 NaN), to (the segment's value alone)."""
    x, y = F.col("value"), F.col("_right")
    # The power keeps the sign of a zero.
    divided = F.when(y == 0, x * F.pow(y.cast("double"), F.lit(-1.0))).otherwise(F.try_divide(x, y))
    out = {"add": x + y, "sub": x - y, "mul": x * y, "div": divided, "to": y}[op]
    return data.join(right.select("seg", F.col("value").alias("_right")), "seg").select("seg", "pos", out.alias("value"))


def softmax(data: DataFrame) -> DataFrame:
    """exp(value - max) over its sum within each segment; maxima and sums are pre-aggregated, not windows."""
    top = data.groupBy("seg").agg(F.max("value").alias("_top"))
    raised = data.join(top, "seg").withColumn("_e", F.exp(F.col("value") - F.col("_top")))
    total = raised.groupBy("seg").agg(F.sum("_e").alias("_total"))
    return raised.join(total, "seg").select("seg", "pos", (F.col("_e") / F.col("_total")).alias("value"))


def softmax_grad(output: DataFrame, grad: DataFrame) -> DataFrame:
    """p * (g - sum of g * p over the segment)."""
    both = output.select("seg", "pos", F.col("value").alias("p")).join(grad.select("seg", "pos", F.col("value").alias("g")), ["seg", "pos"])
    inner = both.groupBy("seg").agg(F.sum(F.col("g") * F.col("p")).alias("_inner"))
    return both.join(inner, "seg").select("seg", "pos", (F.col("p") * (F.col("g") - F.col("_inner"))).alias("value"))


def broadcast_mul_grad(data: DataFrame, grad: DataFrame, segments: DataFrame) -> DataFrame:
    """Gradient of `mul` for the segments' values: the sum of g * value; that for data is broadcast(grad, right, "mul")."""
    both = data.join(grad.select("seg", "pos", F.col("value").alias("_g")), ["seg", "pos"])
    return reduce(both.select("seg", (F.col("value") * F.col("_g")).alias("value")), segments, "sum")


#: Positions of one block of a running maximum.
BLOCK = 1 << 16


def segment_ids(starts: DataFrame, positions: DataFrame) -> DataFrame:
    """(pos) with the segment it lies in, given (seg, start): a running maximum over positions.

    Blocks of BLOCK positions are scanned side by side; what the blocks before hold is carried in as their maximum, by a window over one
    row a block.
    """
    marked = positions.join(starts.groupBy(F.col("start").alias("pos")).agg(F.max("seg").alias("_seg")), "pos", "left").withColumn("_block", F.floor(F.col("pos") / BLOCK))
    before = W.Window.orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = marked.groupBy("_block").agg(F.max("_seg").alias("_most")).select("_block", F.max("_most").over(before).alias("_carried"))
    within = F.max("_seg").over(W.Window.partitionBy("_block").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0))
    return marked.withColumn("_own", within).join(carried, "_block").select("pos", F.greatest("_own", "_carried").alias("seg"))


def pool(edges: DataFrame, vectors: DataFrame, segments: DataFrame, how: str, dim: int, weight: str | None = None, decimals: int | None = None) -> DataFrame:
    """Vectors of a segment's members, reduced component by component: (seg, i, value), zeros for an empty segment.

    edges: (seg, id) and the weight's column; vectors: (id, vector) of `dim` components. The components are aggregates of one
    hash aggregation, so that vectors are never exploded before the shuffle.
    """
    x = [F.get("vector", F.lit(i)).cast("double") for i in range(dim)]
    w = F.col(weight) if weight else None
    fold = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]
    joined = edges.join(vectors, "id")
    reduced = joined.groupBy("seg").agg(*[fold(c * w if weight else c).alias(f"c{i}") for i, c in enumerate(x)])
    out = reduced.select("seg", F.array(*[f"c{i}" for i in range(dim)]).alias("vector"))
    filled = segments.select("seg").join(out, "seg", "left").select("seg", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)).alias("vector"))
    value = F.col("value") if decimals is None else F.round("value", decimals)
    return filled.select("seg", F.posexplode("vector").alias("i", "value")).select("seg", "i", value.alias("value"))


def max_pool_winner(edges: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(seg, i, pos): the member that wins each component, the first on ties; edges have (seg, pos, id)."""
    best = [F.max(F.struct(F.get("vector", F.lit(i)).cast("double").alias("v"), (-F.col("pos")).alias("p"))).alias(f"c{i}") for i in range(dim)]
    won = edges.join(vectors, "id").groupBy("seg").agg(*best)
    return won.select("seg", F.posexplode(F.array(*[-F.col(f"c{i}.p") for i in range(dim)])).alias("i", "pos"))


def inner_product(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges with the inner product of their ends' vectors; left and right are (id, vector)."""
    return _ends(edges, left, right, lambda a, b: a * b)


def squared_distance(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return _ends(edges, left, right, lambda a, b: (a - b) * (a - b))


def _ends(edges: DataFrame, left: DataFrame, right: DataFrame, term) -> DataFrame:
    joined = edges.join(left.select(F.col("id").alias("src"), F.col("vector").alias("_a")), "src").join(right.select(F.col("id").alias("dst"), F.col("vector").alias("_b")), "dst")
    terms = F.zip_with("_a", "_b", lambda a, b: term(a.cast("double"), b.cast("double")))
    return joined.withColumn("value", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).drop("_a", "_b")


def pool_grad(edges: DataFrame, grads: DataFrame, segments: DataFrame, dim: int, average: bool = False, weight: str | None = None) -> DataFrame:
    """Gradient of a sum, average or weighted pool for its vectors: each member gets its segments' gradients (seg, vector).

    The pool over transposed edges: members become segments. segments: (seg) of the members.
    """
    turned = edges
    scale: Column | None = F.col(weight) if weight else None
    if average:
        turned = turned.join(edges.groupBy("seg").agg((1.0 / F.count("*")).alias("_share")), "seg")
        scale = F.col("_share")
    turned = turned.withColumn("_w", scale if scale is not None else F.lit(1.0)).select(F.col("id").alias("seg"), F.col("seg").alias("id"), "_w")
    return pool(turned, grads.select(F.col("seg").alias("id"), "vector"), segments, "sum", dim, "_w")


def max_pool_grad(edges: DataFrame, winners: DataFrame, grads: DataFrame) -> DataFrame:
    """Gradient of a max pool for its vectors (id, i, value): a component's gradient goes to the member that won it."""
    won = winners.join(edges.select("seg", "pos", "id"), ["seg", "pos"])
    given = grads.select("seg", F.posexplode("vector").alias("i", "g"))
    return won.join(given, ["seg", "i"]).groupBy("id", "i").agg(F.sum("g").alias("value"))
