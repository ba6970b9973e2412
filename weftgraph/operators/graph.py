"""Edge tables: building, selecting, looking up, removing, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def build_graph(pairs: DataFrame, merge: str = "sum") -> DataFrame:
    """Edges (src, dst, value) from rows that may repeat: values of one pair are summed, or merged by max or min; a null value counts 1."""
    how = {"sum": F.sum, "max": F.max, "min": F.min}[merge]
    return pairs.groupBy("src", "dst").agg(how(F.coalesce(F.col("value"), F.lit(1))).alias("value"))


def link_types(edges: DataFrame) -> DataFrame:
    """The domain of edge values, numbered in order. The window runs over the domain, not over edges."""
    return edges.select("value").distinct().select((F.row_number().over(W.Window.orderBy("value")) - 1).alias("link_id"), "value")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def degrees(edges: DataFrame, nodes: DataFrame, side: str = "src") -> DataFrame:
    """(id, degree) for every node, zero included."""
    counted = edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("int").alias("degree"))


def shared(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each.

    Neither the filters that joins infer nor the choice of columns pass a generator, so every use of these rows has the same plan below, and
    its exchanges are written once instead of once for each use.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def with_support(edges: DataFrame, symmetric: bool = True) -> DataFrame:
    """Edges with the weight sqrt(1 / deg(src) / deg(dst)), or 1 / deg(src).

    Degrees are aggregated before they are joined, so that a hub isn't one window partition. src is joined last: what is aggregated by src next needs no
    further exchange.
    """
    found = edges = shared(edges)
    if symmetric:
        cols = edges.groupBy("dst").agg(F.count("*").alias("_c"))
        found = edges.join(cols, "dst")
    rows = edges.groupBy("src").agg(F.count("*").alias("_r"))
    found = found.join(rows, "src")
    if not symmetric:
        return found.withColumn("support", 1.0 / F.col("_r")).drop("_r")
    return found.withColumn("support", F.sqrt(1.0 / F.col("_r") / F.col("_c"))).drop("_r", "_c")


#: Values that are looked at to cut an order into parts, and how many of them make a part. Parts hold about one in 128 rows of a large table.
_LOOKED, _APART = 4096, 32


def running(rows: DataFrame, order: str, amount: Column | None = None, name: str = "ind") -> DataFrame:
    """Rows with the sum of `amount` (a row each if None) over all rows that stand before them in the order of a column of different values.

    The column's values of least hash, a bounded number of them, cut the order into parts. Parts are summed first, then each is
    ordered by itself, so that no task sees all rows. Where the cuts fall changes no result.
    """
    amount = F.lit(1) if amount is None else amount
    looked = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(_LOOKED).collect())
    cuts = [F.lit(c) for c in looked[_APART::_APART]]
    marked = rows.withColumn("_part", F.size(F.filter(F.array(*cuts), lambda c: c <= F.col(order))) if cuts else F.lit(0))
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    sums = marked.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    # At most 128 rows are broadcast.
    first = sums.select("_part", before(W.Window.orderBy("_part"), F.col("_sum")).alias("_first"))
    within = marked.withColumn("_within", before(W.Window.partitionBy("_part").orderBy(order), amount))
    return within.join(F.broadcast(first), "_part").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_first") + F.col("_within")).alias(name))


def index_of(nodes: DataFrame) -> DataFrame:
    """(id, ind): positions in the order of ids, from 0."""
    return running(nodes.select("id"), "id").select("id", F.col("ind").cast("int").alias("ind"))


def id_to_index(ids: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """(ord, id, ind) for requested ids; -1 where there is no such node, or without such rows if strict."""
    found = ids.join(index_of(nodes), "id", "inner" if strict else "left")
    return found.select("ord", "id", F.coalesce("ind", F.lit(-1)).alias("ind"))


def take(values: DataFrame, positions: DataFrame) -> DataFrame:
    """Gather: (ord, pos) joined with (pos, value), order kept in ord."""
    return positions.join(values, "pos").select("ord", "pos", "value")


def features_by_id(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    return ids.join(nodes, "id").select("ord", "id", "features")


def submatrix(edges: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Edges whose ends are among (id, ord) of rows and cols, with the positions of the ends in these selections; None takes all."""
    found = edges
    for side, chosen in (("src", rows), ("dst", cols)):
        if chosen is not None:
            found = found.join(chosen.select(F.col("id").alias(side), F.col("ord").alias(f"{side}_ind")), side)
    return found


def induced(edges: DataFrame, ids: DataFrame, sides: tuple[str, ...] = ("src",)) -> DataFrame:
    """Edges whose ends on the named sides are among ids."""
    for side in sides:
        edges = edges.join(ids.select(F.col("id").alias(side)), side, "left_semi")
    return edges


def csr_to_coo(pointers: DataFrame) -> DataFrame:
    """(row, begin, end) to one (row, pos) for each position."""
    return pointers.where("end > begin").select("row", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("pos"))


def coo_to_csr(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row, begin, end) of each node's edges when edges stand by src; empty rows have begin = end."""
    counted = degrees(edges, nodes).select(F.col("id").alias("row"), F.col("degree").cast("long").alias("n"))
    return running(counted, "row", F.col("n"), "begin").select("row", "begin", (F.col("begin") + F.col("n")).alias("end"))


def edge_list(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Edges by positions of their ends."""
    s, d = index_of(src_nodes), index_of(dst_nodes)
    return edges.join(s.select(F.col("id").alias("src"), F.col("ind").alias("src_ind")), "src").join(d.select(F.col("id").alias("dst"), F.col("ind").alias("dst_ind")), "dst").select("src_ind", "dst_ind", "value")


def graph_summary(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, nnz."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(src_nodes, "n_rows").crossJoin(one(dst_nodes, "n_cols")).crossJoin(one(edges, "nnz"))


def multi_link_split(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges by link type: (link_id, src, pos, dst), pos the place from 0 among a node's edges of that type, in the order of dst."""
    place = F.row_number().over(W.Window.partitionBy("link_id", "src").orderBy("dst")) - 1
    return edges.join(F.broadcast(types), "value").withColumn("pos", place).select("link_id", "src", "pos", "dst")


def link_degrees(edges: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """(link_id, id, n): how many edges of each link type every node has, 0 included. Types are the few values of an edge."""
    typed = edges.join(F.broadcast(types), "value").groupBy("link_id", F.col("src").alias("id")).agg(F.count("*").alias("n"))
    grid = nodes.select("id").crossJoin(F.broadcast(types.select("link_id")))
    return grid.join(typed, ["link_id", "id"], "left").select("link_id", "id", F.coalesce("n", F.lit(0)).alias("n"))


def outside_domain(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges whose value no link type has; a split needs this to be empty."""
    return edges.join(types, "value", "left_anti")


def fetch_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, src, dst) to the pair's value, 0 where there is no edge; repeated requests stay."""
    return pairs.join(edges, ["src", "dst"], "left").select("ord", "src", "dst", F.coalesce("value", F.lit(0)).alias("value"))


def remove_edges(edges: DataFrame, pairs: DataFrame, both: bool = False) -> DataFrame:
    """Edges without the listed pairs; pairs that aren't there don't matter. both: also their reverse, for symmetric relations."""
    gone = pairs.select("src", "dst")
    if both:
        gone = gone.unionByName(transpose(gone)).distinct()
    return edges.join(gone, ["src", "dst"], "left_anti")


def drop_unseen(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    return nodes.join(edges.select(F.col(side).alias("id")), "id", "left_semi")


def densify(edges: DataFrame) -> DataFrame:
    """Edges by dense ids from 0 on either side, in the order of the ids that occur."""
    s = index_of(edges.select(F.col("src").alias("id")).distinct())
    d = index_of(edges.select(F.col("dst").alias("id")).distinct())
    return edges.join(s.select(F.col("id").alias("src"), F.col("ind").alias("s")), "src").join(d.select(F.col("id").alias("dst"), F.col("ind").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "value")


def is_submatrix(small: DataFrame, large: DataFrame) -> DataFrame:
    """One row: n_missing edges of small that large lacks or has with another value, and whether there are none."""
    same = (small["src"] == large["src"]) & (small["dst"] == large["dst"]) & small["value"].eqNullSafe(large["value"])
    return small.join(large, same, "left_anti").agg(F.count("*").alias("n_missing")).select("n_missing", (F.col("n_missing") == 0).alias("is_submatrix"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: edges that only one of two graphs has, or has with another value, and whether the graphs are equal."""
    lacks = lambda x, y: x.select("src", "dst", "value").exceptAll(y.select("src", "dst", "value"))
    return lacks(a, b).unionAll(lacks(b, a)).agg(F.count("*").alias("n_different")).select("n_different", (F.col("n_different") == 0).alias("equal"))


def from_coordinates(rows: DataFrame, src_nodes: DataFrame | None = None, dst_nodes: DataFrame | None = None) -> DataFrame:
    """Edges from (src_ind, dst_ind, value), the positions of nodes in the order of their ids; without nodes the positions are the ids. Undoes edge_list()."""
    for side, nodes in (("src", src_nodes), ("dst", dst_nodes)):
        if nodes is None:
            rows = rows.withColumn(side, F.col(f"{side}_ind").cast("long"))
        else:
            rows = rows.join(index_of(nodes).select(F.col("id").alias(side), F.col("ind").alias(f"{side}_ind")), f"{side}_ind")
    return rows.select("src", "dst", "value")


def grown(nodes: DataFrame, edges: DataFrame, more: DataFrame, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an undirected set graph after insertions `more` (ord, src, dst) in the order of ord.

    A pair counts once, whichever way round and however often it comes; a self loop adds its node only. Insertion stops before the
    first row that would pass a cap. nodes: (id), edges: (a, b) with a < b.
    """
    pair = lambda c: c.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "ord")
    ends = more.select(F.col("src").alias("id"), "ord").unionAll(more.select(F.col("dst").alias("id"), "ord"))
    new_nodes = ends.groupBy("id").agg(F.min("ord").alias("ord")).join(nodes.select("id"), "id", "left_anti")
    new_edges = pair(more.where("src <> dst")).groupBy("a", "b").agg(F.min("ord").alias("ord")).join(edges.select("a", "b"), ["a", "b"], "left_anti")
    for new, old, most in ((new_nodes, nodes, max_nodes), (new_edges, edges, max_edges)):
        if most is not None:
            at = running(new.groupBy("ord").agg(F.count("*").alias("_n")), "ord", F.col("_n"), "_had")
            over = at.where(F.col("_had") + F.col("_n") > most - old.count()).agg(F.min("ord")).first()[0]
            if over is not None:
                new_nodes, new_edges = new_nodes.where(F.col("ord") < over), new_edges.where(F.col("ord") < over)
    return nodes.select("id").unionAll(new_nodes.select("id")), edges.select("a", "b").unionAll(new_edges.select("a", "b"))


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that leave the given ids."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src")


def mismatches(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """One row: pairs on which a relation and its stored transpose disagree."""
    f = forward.select("src", "dst", F.col("value").alias("a"))
    b = transpose(backward).select("src", "dst", F.col("value").alias("b"))
    return f.join(b, ["src", "dst"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count("*").alias("n_mismatch"))


def repeated_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def contiguous(nodes: DataFrame) -> DataFrame:
    """One row: whether ids are 0..n-1."""
    row = nodes.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("different"), F.count("*").alias("n"))
    return row.select("n", F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("different") == F.col("n")), F.col("n") == 0).alias("contiguous"))


def unique_counts(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def unique_inverse(values: DataFrame, order: str, column: str) -> DataFrame:
    """(ord, value, place): each input's place among the different values, numbered by first appearance.

    `order` tells all inputs apart. The different values are numbered, and inputs join them.
    """
    first = values.groupBy(column).agg(F.min(order).alias("_at"))
    placed = running(first, "_at", name="place").select(column, F.col("place").cast("int").alias("place"))
    return values.join(placed, column).select(F.col(order).alias("ord"), F.col(column).alias("value"), "place")


def merge_nodes(parts: dict[str, DataFrame]) -> DataFrame:
    """(source, id, place): the inputs' ids, each with its place in the ordered union of all."""
    tagged = None
    for name, ids in parts.items():
        one = ids.select(F.lit(name).alias("source"), "id")
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.join(index_of(tagged.select("id").distinct()).withColumnRenamed("ind", "place"), "id").select("source", "id", "place")


def merge_typed_nodes(parts: DataFrame) -> DataFrame:
    """(type, source, id) to each row's place in the union of its type; the window runs over one type's different ids."""
    union = parts.select("type", "id").distinct()
    placed = union.withColumn("place", (F.row_number().over(W.Window.partitionBy("type").orderBy("id")) - 1).cast("int"))
    return parts.join(placed, ["type", "id"]).select("type", "source", "id", "place")


def expand_frontier(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Ids reached in at most so many hops, seeds included; distinct after each hop."""
    reached = seeds.select("id").distinct()
    for _ in range(hops):
        step = edges.join(reached.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        reached = reached.unionByName(step).distinct()
    return reached


def meta_matrix(relations: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Edge counts of relations: src_type, dst_type, nnz, n_link_types."""
    found = None
    for (src, dst), edges in relations.items():
        one = edges.agg(F.count("*").alias("nnz"), F.countDistinct("value").alias("n_link_types")).select(F.lit(src).alias("src_type"), F.lit(dst).alias("dst_type"), "nnz", "n_link_types")
        found = one if found is None else found.unionByName(one)
    return found


def pair_key(a: Column, b: Column) -> Column:
    """An unordered pair as one key."""
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))
