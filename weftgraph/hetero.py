"""Heterogeneous graphs: node tables by type, one edge table for each pair of types, its reverse as a view."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .operators import graph


@dataclass(frozen=True)
class HeteroGraph:
    """nodes[type] is (id, features...), relations[src, dst] is (src, dst, value). Every change gives a new graph over the same tables."""

    nodes: dict[str, DataFrame]
    relations: dict[tuple[str, str], DataFrame]

    def __post_init__(self) -> None:
        for a, b in self.relations:
            if a != b and (b, a) in self.relations:
                raise ValueError(f"{a} and {b} are stored twice; the reverse is a view")
            if a not in self.nodes or b not in self.nodes:
                raise ValueError(f"no nodes of {a} or {b}")

    def __getitem__(self, pair: tuple[str, str]) -> DataFrame:
        if pair in self.relations:
            return self.relations[pair]
        return graph.transpose(self.relations[pair[1], pair[0]])

    def pairs(self) -> list[tuple[str, str]]:
        """All relations, reverses included."""
        return sorted({p for a, b in self.relations for p in ((a, b), (b, a))})

    def _with(self, pair: tuple[str, str], edges: DataFrame) -> HeteroGraph:
        stored = pair in self.relations
        key = pair if stored else (pair[1], pair[0])
        return replace(self, relations=self.relations | {key: edges if stored else graph.transpose(edges)})

    def remove_edges(self, pair: tuple[str, str], pairs: DataFrame) -> HeteroGraph:
        """Without the listed (src, dst) of one relation, and so without their reverse; within one type in both orientations."""
        return self._with(pair, graph.remove_edges(self[pair], pairs, both=pair[0] == pair[1]))

    def select(self, kind: str, ids: DataFrame) -> HeteroGraph:
        """Restricted to some ids of one type, on every relation that it is part of."""
        relations = {}
        for (a, b), edges in self.relations.items():
            sides = tuple(side for side, t in (("src", a), ("dst", b)) if t == kind)
            relations[a, b] = graph.induced(edges, ids, sides) if sides else edges
        return replace(self, nodes=self.nodes | {kind: self.nodes[kind].join(ids.select("id"), "id", "left_semi")}, relations=relations)

    def fetch_edges(self, pair: tuple[str, str], pairs: DataFrame) -> DataFrame:
        return graph.fetch_edges(self[pair], pairs)

    def summary(self) -> DataFrame:
        return graph.meta_matrix({p: self[p] for p in self.pairs()})

    def save(self, path: str) -> None:
        """Parquet tables of all nodes and relations, and a small one that names them."""
        names = [(kind, None) for kind in self.nodes] + list(self.relations)
        for kind, df in self.nodes.items():
            df.write.mode("overwrite").parquet(f"{path}/nodes/type={kind}")
        for (a, b), df in self.relations.items():
            df.write.mode("overwrite").parquet(f"{path}/relations/{a}__{b}")
        spark = next(iter(self.nodes.values())).sparkSession
        spark.createDataFrame(names, "src_type string, dst_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HeteroGraph:
        """What save() wrote: its types and relations are read from the table of names, a row for each."""
        names = [tuple(r) for r in spark.read.parquet(f"{path}/names").collect()]
        nodes = {a: spark.read.parquet(f"{path}/nodes/type={a}") for a, b in names if b is None}
        return cls(nodes, {(a, b): spark.read.parquet(f"{path}/relations/{a}__{b}") for a, b in names if b is not None})

    def types(self) -> list[str]:
        return sorted(self.nodes)

    def relations_of(self, kind: str) -> list[tuple[str, str]]:
        """The relations that leave a type, reverses included."""
        return [p for p in self.pairs() if p[0] == kind]
