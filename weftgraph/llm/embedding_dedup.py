"""Embedding near-dedup by NN-descent over a shared neighbour graph, with completed lists and audited recall."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import components, saved, ship, whole_groups

THRESHOLD = 0.98
#: Neighbours in a list, trees of random hyperplanes for the first lists, sign bits of a tree's code, rows of a window.
NEIGHBOURS, TREES, BITS, WINDOW = 6, 6, 24, 64
#: A list full of links is saturated and doubles, to so many neighbours at most; beyond that complete() counts.
MOST = 48
#: Rounds of descent at most, and rows of one block when the lists of a component are completed.
ROUNDS, BLOCK = 3, 256
#: Vectors whose links are counted by brute force to measure recall, the recall below which more trees are grown, and that below which the result is refused.
AUDITED, RECALL, REFUSED = 2000, 0.999, 0.9
_LINKS = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share a key, from batches sorted by it."""
    keys = lambda table: table.column(key).to_numpy(zero_copy_only=False)
    for table in whole_groups(batches, lambda t: [keys(t)], 1 << 14):
        values = keys(table)
        ends = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), table.num_rows]
        for a, b in zip(ends, ends[1:], strict=False):
            yield table.slice(a, b - a)


def _best(ids: np.ndarray, units: np.ndarray, most: int) -> pa.RecordBatch:
    """For each of some vectors its nearest others among them, at most `most`."""
    cosine = units @ units.T
    np.fill_diagonal(cosine, -2)
    near = np.argpartition(-cosine, min(most, len(ids) - 1) - 1, axis=1)[:, : min(most, len(ids) - 1)]
    row = np.repeat(np.arange(len(ids)), near.shape[1])
    return pa.record_batch([pa.array(ids[row]), pa.array(ids[near.ravel()]), pa.array(cosine[row, near.ravel()])], schema=_LINKS)


def _coded(nodes: DataFrame, seed: int) -> DataFrame:
    """Each node once a tree: the signs of its projections on BITS random directions, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(3)).to_numpy()
            for dim in np.unique(lengths).tolist():
                same = batch.filter(pa.array(lengths == dim))
                units = _unit(same.column(3))
                for tree in range(TREES):
                    planes = np.random.default_rng([seed, tree, dim]).standard_normal((dim, BITS))
                    code = ((units @ planes > 0) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(1)
                    yield pa.record_batch([pa.array(np.full(len(code), tree, np.int32)), same.column(1), pa.array(code), same.column(0), same.column(3)], names=["tree", "kind", "code", "id", "vector"])

    return nodes.select("id", "kind", "n", "vector").mapInArrow(run, "tree int, kind string, code long, id long, vector array<float>")


def first_lists(nodes: DataFrame, seed: int, tasks: int) -> DataFrame:
    """Neighbours (id, other, cosine) within windows of nodes in the order of their codes, tree by tree.

    Ranges of the order are dealt, not codes: a large set of near copies spreads over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "of"):
            ids, units = table.column("id").to_numpy(), _unit(table.column("vector"))
            for k in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2):
                if len(ids[k : k + WINDOW]) > 1:
                    yield _best(ids[k : k + WINDOW], units[k : k + WINDOW], NEIGHBOURS)

    coded = _coded(nodes, seed).withColumn("of", F.concat_ws("/", "tree", "kind"))
    return coded.repartitionByRange(tasks, "of", "code", "id").sortWithinPartitions("of", "code", "id").select("of", "id", "vector").mapInArrow(run, "id long, other long, cosine double")


def nearest(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The nearest of each id, ties by id: (id, other, cosine, most). A list holds `most`, NEIGHBOURS at first; one that is
    full of links may miss others, so it doubles for the next round, up to MOST."""
    by_id = W.Window.partitionBy("id")
    rows = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"), F.max("most").alias("most"))
    rows = rows.withColumn("most", F.coalesce(F.max("most").over(by_id), F.lit(NEIGHBOURS)))
    rows = rows.withColumn("_rank", F.row_number().over(by_id.orderBy(F.desc("cosine"), "other"))).where(F.col("_rank") <= F.col("most"))
    full = F.sum((F.col("cosine") >= threshold).cast("int")).over(by_id) >= F.col("most")
    return rows.select("id", "other", "cosine", F.when(full, F.least(2 * F.col("most"), F.lit(MOST))).otherwise(F.col("most")).alias("most"))


def descend(lists: DataFrame, nodes: DataFrame, tasks: int) -> DataFrame:
    """One round: at each node its neighbours, and as many of those that name it, are joined with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for table in _groups(batches, "at"):
            if table.num_rows > 1:
                waiting.append(_best(table.column("id").to_numpy(), _unit(table.column("vector")), NEIGHBOURS))
                rows += waiting[-1].num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    back = W.Window.partitionBy("at").orderBy(F.xxhash64("at", "id"))
    named = lists.select(F.col("other").alias("at"), "id").withColumn("_rank", F.row_number().over(back)).where(F.col("_rank") <= NEIGHBOURS).drop("_rank")
    around = lists.select(F.col("id").alias("at"), F.col("other").alias("id")).unionByName(named).unionByName(lists.select(F.col("id").alias("at"), "id")).distinct()
    return around.join(nodes.select("id", "vector"), "id").repartition(tasks, "at").sortWithinPartitions("at", "id").select("at", "id", "vector").mapInArrow(run, "id long, other long, cosine double")


def _counted(rows: DataFrame, tasks: int, count: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "unit"):
            ids, block, n = (table.column(c).to_numpy() for c in ("id", "block", "n"))
            yield count(ids, block, n, _unit(table.column("vector")))

    return rows.repartition(tasks, "unit").sortWithinPartitions("unit", "block", "id").select("unit", "id", "block", "n", "vector").mapInArrow(run, "id long, links long")


def complete(found: DataFrame, nodes: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """Links of each id (id, links): the lists of a component's nodes are enlarged to the whole component.

    A list that is full of links is saturated: more links may lie beyond it, but none beyond its component. Components are compared
    in pairs of blocks of BLOCK nodes, and only counts leave a task.
    """

    def count(ids: np.ndarray, block: np.ndarray, n: np.ndarray, units: np.ndarray) -> pa.RecordBatch:
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        if (several := block != block[0]).any():  # pairs within a block are counted where that block stands alone
            near &= several[:, None] != several[None, :]
        return pa.record_batch([pa.array(ids), pa.array((near * n).sum(1).astype(np.int64))], names=["id", "links"])

    sizes = saved(found.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    members = found.join(sizes, "component_id").join(nodes.select("id", "n", "vector"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.concat_ws("/", "component_id", F.least("block", "with"), F.greatest("block", "with"))
    return _counted(dealt.withColumn("unit", unit), tasks, count).groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int = AUDITED) -> float:
    """The share of a bounded sample's true links, counted against all vectors, that were found."""
    share = min(1.0, sample / max(1, nodes.count()))
    asked = nodes.where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * sample).select("id", "kind", "vector").toArrow()
    if not asked.num_rows:
        return 1.0
    by_kind = {}
    kinds = np.array(asked.column("kind").to_pylist())
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        by_kind[str(kind)] = (asked.column("id").to_numpy()[at], _unit(asked.column("vector").take(pa.array(at))))
    sent = nodes.sparkSession.sparkContext.broadcast(by_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, n = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), batch.column(2).to_numpy()
            for kind in np.unique(kinds):
                if (asked := sent.value.get(str(kind))) is not None:
                    at = np.flatnonzero(kinds == kind)
                    near = asked[1] @ _unit(batch.column(3).take(pa.array(at))).T >= threshold
                    near &= asked[0][:, None] != ids[at][None, :]
                    yield pa.record_batch([pa.array(asked[0]), pa.array((near * n[at]).sum(1).astype(np.int64))], names=["id", "true"])

    true = nodes.select("id", "kind", "n", "vector").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    row = true.join(links, "id", "left").agg(F.sum("true").alias("true"), F.sum(F.coalesce("links", F.lit(0))).alias("found")).first()
    return (row["found"] or 0) / row["true"] if row["true"] else 1.0


def _valid() -> Column:
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~odd & (norm > 0), F.lit(False))


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate vectors of one label: vec_id, n_links, component_id, kept.

    Takes vec_id, embedding (array<float>) and label; other columns are ignored. Vectors of different lengths, without label, id, with null or
    non-finite components or of length zero link with nothing. Repeated rows are separate vectors that link; an empty
    table gives no rows. Equal vectors are merged first. The rest is a neighbour graph refined by neighbours of neighbours
    until no more links appear, with longer lists where they are saturated; its links' components are completed, and if the audited recall falls
    short, more trees are grown; a recall under REFUSED raises an error.
    """
    ship(vectors.sparkSession)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("vec_id", "embedding", "label").withColumn("valid", _valid())
    kind = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    rows = saved(rows.withColumn("kind", F.when(F.col("valid"), kind)).withColumn("h", F.when(F.col("valid"), F.xxhash64("label", "embedding"))).withColumn("g", F.when(F.col("valid"), F.hash("label", "embedding"))))
    nodes = rows.where("valid").groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("kind").alias("kind"), F.first("embedding").alias("vector"))
    nodes = saved(nodes.select("id", "n", "kind", F.col("vector").cast("array<float>").alias("vector"), "h", "g"))
    lists, links = None, saved(nodes.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id")).limit(0))
    for seed in range(4):
        found = first_lists(nodes, seed, tasks)
        lists = saved(nearest(found.withColumn("most", F.lit(None).cast("int")) if lists is None else found.unionByName(lists, allowMissingColumns=True), threshold))
        edges = saved(lists.where(F.col("cosine") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b")))
        for _ in range(ROUNDS):
            more = saved(descend(lists, nodes, tasks).unionByName(lists, allowMissingColumns=True))
            lists = saved(nearest(more, threshold))
            now = saved(more.where(F.col("cosine") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(edges).distinct())
            grown, edges = now.count() > edges.distinct().count(), now
            if not grown:
                break
        joined = saved(components(edges))
        links = saved(complete(joined, nodes, threshold, tasks).join(joined, "id").select("id", "links", "component_id"))
        if (recall := audit(nodes, links, threshold)) >= RECALL:
            break
        logging.getLogger(__name__).warning("recall %.4f after %d trees", recall, (seed + 1) * TREES)
    if recall < REFUSED:
        raise RuntimeError(f"only {recall:.4f} of the audited links were found")
    classes = saved(nodes.select("id", "n", "h", "g").join(links, "id", "left").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    linked = rows.where("valid").join(classes, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null),
near as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id < b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
both_ways as (select a, b from near union all select b, a from near),
degree as (select a, count(*) n from both_ways group by a),
reach as (select a, a b from degree union select r.a, e.b from reach r join both_ways e on r.b = e.a),
least as (select a, min(b) c from reach group by a)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(c, vec_id) component_id, coalesce(c, vec_id) = vec_id kept
from embeddings left join degree d on vec_id = d.a left join least l on vec_id = l.a
"""
