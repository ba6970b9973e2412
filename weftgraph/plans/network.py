"""Graph-convolution layers over edge tables: aggregators, layers, k-hop plans, rating prediction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import activation
from ..operators.graph import with_support
from ..operators.sampling import sample_neighbors
from ..operators.segment import inner_product

Matrix = list[list[float]]


@dataclass
class Dense:
    """out = x W^T + b; small driver-side weights become literals of the plan."""

    weight: Matrix
    bias: list[float] | None = None

    def of(self, x: Column) -> Column:
        rows = []
        for k, row in enumerate(self.weight):
            dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            rows.append(dot + float(self.bias[k]) if self.bias else dot)
        return F.array(*rows)


#: Mapped vectors of at most so many bytes are sent to all executors.
_SENT = 8 << 20


def _small(vectors: DataFrame, numbers: int) -> bool:
    """Whether vectors of so many numbers take at most _SENT bytes. They are counted, no further than needed, only where Spark estimates little to read."""
    most = _SENT // (8 * numbers)
    read = int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return read <= _SENT and vectors.select("id").limit(most + 1).count() <= most


@dataclass
class Aggregator:
    """Links of each type have their own dense map; types combine by `stack` (concatenation) or `sum`.

    ordinal: the map of type i is the sum of the maps of types up to i.
    """

    maps: list[Dense]
    combine: str = "sum"
    act: str = "leaky"
    ordinal: bool = False

    def __post_init__(self) -> None:
        if self.combine not in ("sum", "stack"):
            raise ValueError(f"combine is sum or stack, not {self.combine!r}")

    def map_of(self, link: int) -> Dense:
        if not self.ordinal:
            return self.maps[link]
        some = self.maps[: link + 1]
        weight = [[sum(m.weight[o][i] for m in some) for i in range(len(some[0].weight[0]))] for o in range(len(some[0].weight))]
        bias = [sum(m.bias[o] for m in some) for o in range(len(weight))] if some[0].bias else None
        return Dense(weight, bias)

    def apply(self, edges: DataFrame, vectors: DataFrame, nodes: DataFrame) -> DataFrame:
        """(id, vector) for every node: edges are (src, dst, link_id, support), vectors (id, vector) of dst.

        A map is linear, so where it shortens vectors it is applied before the pool, once a vector and type, and else after it, once a
        node and type; never once an edge. Its bias counts with the sum of supports. A null component adds nothing.
        """
        dim, units = len(self.maps[0].weight[0]), len(self.maps[0].weight)
        maps = [self.map_of(link) for link in range(len(self.maps))]
        first = units < dim
        x = [F.get("vector", F.lit(i)).cast("double") for i in range(dim)]
        if first:
            small = _small(vectors, len(maps) * units)
            filled = F.array(*[F.coalesce(c, F.lit(0.0)) for c in x])
            mapped = F.when(F.coalesce(*x).isNotNull(), F.array(*[Dense(m.weight).of(filled) for m in maps]))
            vectors = vectors.select("id", mapped.alias("vector"))
            vectors = F.broadcast(vectors) if small else vectors
            edges = edges.where(F.col("link_id").between(0, len(maps) - 1))
            x = [F.get(F.get("vector", F.col("link_id").cast("int")), F.lit(o)) for o in range(units)]
        sums = [F.sum(c * F.col("support")).alias(f"c{i}") for i, c in enumerate(x)]
        pooled = edges.join(vectors.withColumnRenamed("id", "dst"), "dst").groupBy("src", "link_id").agg(F.sum("support").alias("_s"), *sums)
        pooled = pooled.select("src", "link_id", "_s", F.array(*[f"c{i}" for i in range(len(x))]).alias("_x"))
        parts = []
        for link, m in enumerate(maps):
            out = F.col("_x") if first else Dense(m.weight).of(F.transform("_x", lambda v: F.coalesce(v, F.lit(0.0))))
            if m.bias:
                out = F.zip_with(out, F.array(*[F.lit(float(b)) for b in m.bias]), lambda v, b: v + b * F.col("_s"))
            parts.append(F.max(F.when((F.col("link_id") == link) & F.exists("_x", lambda v: v.isNotNull()), out)).alias(f"l{link}"))
        wide = pooled.groupBy("src").agg(*parts)
        zero = F.array_repeat(F.lit(0.0), units)
        full = nodes.select(F.col("id").alias("src")).join(wide, "src", "left")
        each = [F.coalesce(f"l{k}", zero) for k in range(len(self.maps))]
        joined = F.concat(*each) if self.combine == "stack" else each[0]
        if self.combine == "sum":
            for one in each[1:]:
                joined = F.zip_with(joined, one, lambda a, b: a + b)
        return full.select(F.col("src").alias("id"), F.transform(joined, lambda v: activation(self.act, v)).alias("vector"))


@dataclass
class Layer:
    """One heterogeneous layer for a node type: aggregators by neighbour type, an optional map of the node itself, an output map."""

    aggregators: dict[str, Aggregator]
    out: Dense
    own: Dense | None = None
    combine: str = "sum"
    act: str = "leaky"

    def __post_init__(self) -> None:
        if self.out is None:
            raise ValueError("a layer needs an output map")

    def apply(self, relations: dict[str, DataFrame], vectors: dict[str, DataFrame], nodes: DataFrame, itself: DataFrame | None = None) -> DataFrame:
        found, names = nodes.select("id"), []
        for kind, aggregator in self.aggregators.items():
            one = aggregator.apply(relations[kind], vectors[kind], nodes)
            found = found.join(one.withColumnRenamed("vector", f"_{kind}"), "id")
            names.append(F.col(f"_{kind}"))
        if self.own is not None:
            # Mapped before the join, which then moves the map's outputs instead of whole vectors.
            found = found.join(itself.select("id", self.own.of(F.col("vector")).alias("_own")), "id", "left")
            names.append(F.coalesce("_own", F.array_repeat(F.lit(0.0), len(self.own.weight))))
        joined = F.concat(*names) if self.combine == "stack" else names[0]
        if self.combine == "sum":
            for one in names[1:]:
                joined = F.zip_with(joined, one, lambda a, b: a + b)
        found = found.select("id", joined.alias("_x"))
        return found.select("id", F.transform(self.out.of(F.col("_x")), lambda v: activation(self.act, v)).alias("vector"))


@dataclass
class Hop:
    ids: DataFrame
    edges: DataFrame
    depth: int = field(default=0)


def khop_plan(relations: dict[str, DataFrame], seeds: dict[str, DataFrame], other: dict[str, str], hops: int, k: int, seed: int = 0) -> list[dict[str, Hop]]:
    """What each layer has to read, from the top down: for each node type its needed ids, and the sampled edges that leave them.

    relations[type] are edges from that type to other[type]. Ids are made distinct at each hop; nothing is computed until
    the layers run.
    """
    plan, need = [], {t: ids.select("id").distinct() for t, ids in seeds.items()}
    for depth in range(hops):
        level, more = {}, dict(need)
        for kind, ids in need.items():
            chosen = sample_neighbors(with_support(relations[kind]), k, f"{seed}/{depth}/{kind}", ids)
            level[kind] = Hop(ids, chosen, depth)
            reached = chosen.select(F.col("dst").alias("id")).distinct()
            to = other[kind]
            more[to] = more[to].unionByName(reached).distinct() if to in more else reached
        plan.append(level)
        need = more
    return plan


def run_plan(plan: list[dict[str, Hop]], layer: dict[str, Aggregator] | list[dict[str, Aggregator]], other: dict[str, str], vectors: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Forward through a plan, deepest hop first. One aggregator a type serves all hops (recurrent stacking), or a list has those of each hop from the top down."""
    state = vectors
    for depth in reversed(range(len(plan))):
        own = layer[depth] if isinstance(layer, list) else layer
        state = {kind: own[kind].apply(hop.edges.withColumn("link_id", F.lit(0)), state[other[kind]], hop.ids) for kind, hop in plan[depth].items()} | {k: v for k, v in state.items() if k not in plan[depth]}
    return state


def dropout(vector: str, key: str, rate: float, seed: int | str) -> Column:
    """For training: each component is 0 with the chance `rate`, others grow by 1 / (1 - rate); the same for the same seed and key."""

    def kept(v: Column, i: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("long")
        return F.when(number % 1_000_000 < round(rate * 1_000_000), 0.0).otherwise(v.cast("double") / (1 - rate))

    return F.transform(vector, kept)


def predict(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner products of pairs' vectors, as predicted ratings."""
    return inner_product(pairs, left, right)
