"""Registered queries: each operator over the order graph (customer, part, quantity or rating), with its SQL.

Ratings 1..5 are a pair's largest quantity in tens; the vector of a part is that of `embeddings` at its key modulo their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .hetero import HeteroGraph
from .operators import graph as g
from .operators import sampling as s
from .operators import segment as seg
from .plans import evaluate, network, splits

DIM = 64
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

RAW = "raw as (select o_custkey src, l_partkey dst, l_quantity q from lineitem join orders on l_orderkey = o_orderkey)"
E = RAW + ", e as (select src, dst, sum(q) as value from raw group by src, dst)"
R = RAW + ", r as (select src, dst, max(cast(ceil(q / 10) as int)) as value from raw group by src, dst)"
SUP = ", s as (select *, sqrt(1.0 / count(*) over (partition by src) / count(*) over (partition by dst)) support from r)"
DRAW = "(('0x' || substr(md5(concat_ws(':', {0})), 1, 12))::bigint % {1})"
RANK = "row_number() over (partition by src order by md5(concat_ws(':', '{0}', src, dst)), dst)"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("q"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return lines.join(orders, "l_orderkey").select("src", "dst", "q")


def quantities(spark: SparkSession, d: str) -> DataFrame:
    return g.build_graph(raw(spark, d).withColumnRenamed("q", "value"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return g.build_graph(raw(spark, d).select("src", "dst", F.ceil(F.col("q") / 10).cast("int").alias("value")), "max")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def builders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))


def small_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def n_vectors(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").count()


def segments(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).withColumnRenamed("id", "seg")


def values(spark: SparkSession, d: str) -> DataFrame:
    return quantities(spark, d).select(F.col("src").alias("seg"), F.col("dst").alias("pos"), "value")


def members(spark: SparkSession, d: str) -> DataFrame:
    """Rated edges as pooled members: seg, pos, id of the vector, support."""
    return g.with_support(ratings(spark, d)).select(F.col("src").alias("seg"), F.col("dst").alias("pos"), (F.col("dst") % n_vectors(spark, d)).alias("id"), "support")


# Graphs: building, selecting, looking up.


@query("build_graph", f"with {E} select * from e")
def _(spark, d):
    return quantities(spark, d)


@query("link_types", f"with {R} select cast(row_number() over (order by value) - 1 as int) link_id, value from (select distinct value from r)")
def _(spark, d):
    return g.link_types(ratings(spark, d)).select(F.col("link_id").cast("int"), "value")


@query("transpose", f"with {E} select dst src, src dst, value from e")
def _(spark, d):
    return g.transpose(quantities(spark, d))


@query("row_degrees", f"with {R} select c_custkey id, cast(count(r.src) as int) degree from customer left join r on src = c_custkey group by 1")
def _(spark, d):
    return g.degrees(ratings(spark, d), customers(spark, d))


@query("col_degrees", f"with {R} select p_partkey id, cast(count(r.dst) as int) degree from part left join r on dst = p_partkey group by 1")
def _(spark, d):
    return g.degrees(ratings(spark, d), parts(spark, d), "dst")


@query("support_symm", f"with {R} {SUP} select src, dst, round(support, 6) support from s")
def _(spark, d):
    return g.with_support(ratings(spark, d)).select("src", "dst", F.round("support", 6).alias("support"))


@query("support_row", f"with {R} select src, dst, round(1.0::double / count(*) over (partition by src), 6) support from r")
def _(spark, d):
    return g.with_support(ratings(spark, d), False).select("src", "dst", F.round("support", 6).alias("support"))


@query("id_to_index", "with n as (select c_custkey id, row_number() over (order by c_custkey) - 1 ind from customer) select o_orderkey ord, o_custkey id, cast(coalesce(ind, -1) as int) ind from orders left join n on o_custkey = n.id")
def _(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("id"))
    return g.id_to_index(asked, customers(spark, d))


@query("take1d", "select o_orderkey ord, o_custkey pos, c_acctbal as value from orders join customer on c_custkey = o_custkey")
def _(spark, d):
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("value"))
    return g.take(held, table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("pos")))


@query("features_by_id", "select p_partkey ord, vec_id id, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 i from part join embeddings on vec_id = p_partkey % (select count(*) from embeddings)")
def _(spark, d):
    asked = parts(spark, d).select(F.col("id").alias("ord"), (F.col("id") % n_vectors(spark, d)).alias("id"))
    found = g.features_by_id(asked, vectors(spark, d).withColumnRenamed("vector", "features"))
    return found.select("ord", "id", F.posexplode("features").alias("i", "value")).select("ord", "id", F.col("i").cast("long"), F.col("value").cast("double"))


_SEL = ", a as (select c_custkey id, cast(row_number() over (order by c_custkey desc) - 1 as int) ord from customer where c_mktsegment = 'BUILDING'), b as (select p_partkey id, cast(row_number() over (order by p_partkey desc) - 1 as int) ord from part where p_size <= 10)"


def _chosen(ids: DataFrame) -> DataFrame:
    return g.running(ids.select("id", (-F.col("id")).alias("_by")), "_by", name="ord").select("id", F.col("ord").cast("int"))


@query("submat_rows", f"with {R} {_SEL} select src, dst, value, ord src_ind from r join a on src = id")
def _(spark, d):
    return g.submatrix(ratings(spark, d), rows=_chosen(builders(spark, d))).select("src", "dst", "value", "src_ind")


@query("submat_cols", f"with {R} {_SEL} select src, dst, value, ord dst_ind from r join b on dst = id")
def _(spark, d):
    return g.submatrix(ratings(spark, d), cols=_chosen(small_parts(spark, d))).select("src", "dst", "value", "dst_ind")


@query("submat_rows_cols", f"with {R} {_SEL} select src, dst, value, a.ord src_ind, b.ord dst_ind from r join a on src = a.id join b on dst = b.id")
def _(spark, d):
    return g.submatrix(ratings(spark, d), _chosen(builders(spark, d)), _chosen(small_parts(spark, d))).select("src", "dst", "value", "src_ind", "dst_ind")


@query("induced_subgraph", f"with {R} select src, dst, value from r where src in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(spark, d):
    graph = HeteroGraph({"user": customers(spark, d), "item": parts(spark, d)}, {("user", "item"): ratings(spark, d)})
    return graph.select("user", builders(spark, d))["user", "item"].select("src", "dst", "value")


_CSR = ", deg as (select c_custkey as row, count(src) n from customer left join r on src = c_custkey group by 1), csr as (select row, cast(sum(n) over (order by row) - n as bigint) as begin, cast(sum(n) over (order by row) as bigint) as \"end\" from deg)"


@query("coo_to_csr", f'with {R} {_CSR} select row, "begin", "end" from csr')
def _(spark, d):
    return g.coo_to_csr(ratings(spark, d), customers(spark, d))


@query("csr_to_coo", f'with {R} {_CSR} select row, unnest(range("begin", "end")) pos from csr')
def _(spark, d):
    return g.csr_to_coo(g.coo_to_csr(ratings(spark, d), customers(spark, d)))


@query("segment_ids", f'with {R} {_CSR}, p as (select unnest(range(0, (select max("end") from csr))) pos) select pos, row as seg from p join csr on pos >= "begin" and pos < "end"')
def _(spark, d):
    csr = g.coo_to_csr(ratings(spark, d), customers(spark, d)).where("end > begin")
    return seg.segment_ids(csr.select(F.col("row").alias("seg"), F.col("begin").alias("start")), g.csr_to_coo(csr).select("pos"))


@query("edge_list", f"with {R}, a as (select c_custkey id, cast(row_number() over (order by c_custkey) - 1 as int) ind from customer), b as (select p_partkey id, cast(row_number() over (order by p_partkey) - 1 as int) ind from part) select a.ind src_ind, b.ind dst_ind, value from r join a on src = a.id join b on dst = b.id")
def _(spark, d):
    return g.edge_list(ratings(spark, d), customers(spark, d), parts(spark, d))


@query("graph_summary", f"with {R} select (select count(*) from customer) n_rows, (select count(*) from part) n_cols, (select count(*) from r) nnz")
def _(spark, d):
    return g.graph_summary(ratings(spark, d), customers(spark, d), parts(spark, d))


_TYPES = ", t as (select cast(row_number() over (order by value) - 1 as int) link_id, value from (select distinct value from r))"


@query("multi_link_split", f"with {R} {_TYPES} select link_id, src, cast(row_number() over (partition by link_id, src order by dst) - 1 as int) pos, dst from r join t using (value)")
def _(spark, d):
    rated = ratings(spark, d)
    return g.multi_link_split(rated, g.link_types(rated).select(F.col("link_id").cast("int"), "value"))


@query("multi_link_degrees", f"with {R} {_TYPES} select link_id, c_custkey id, count(src) n from customer cross join t left join r on src = c_custkey and r.value = t.value group by 1, 2")
def _(spark, d):
    rated = ratings(spark, d)
    return g.link_degrees(rated, customers(spark, d), g.link_types(rated).select(F.col("link_id").cast("int"), "value"))


@query("sample_neighbors_links", f"with {R} {_TYPES}, k as (select src, dst, value from (select *, {RANK.format(14)} k from r) where k <= 5) select link_id, src, cast(row_number() over (partition by link_id, src order by dst) - 1 as int) pos, dst from k join t using (value)")
def _(spark, d):
    rated = ratings(spark, d)
    return g.multi_link_split(s.sample_neighbors(rated, 5, 14), g.link_types(rated).select(F.col("link_id").cast("int"), "value"))


@query("multi_link_structure", f"with {R} select count(distinct value) n_link_types from r")
def _(spark, d):
    return ratings(spark, d).agg(F.countDistinct("value").alias("n_link_types"))


@query("adjacency_to_csr", f"with {R}, u as (select src, cast(row_number() over (order by src) - 1 as int) s from (select distinct src from r)), i as (select dst, cast(row_number() over (order by dst) - 1 as int) t from (select distinct dst from r)) select s src, t dst, value from r join u using (src) join i using (dst)")
def _(spark, d):
    return g.densify(ratings(spark, d))


_ASK = ", ask as (select o_orderkey ord, o_custkey src, o_orderkey % (select count(*) from part) dst from orders)"


def _asked(spark, d):
    n = parts(spark, d).count()
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst"))


@query("fetch_edges", f"with {R} {_ASK} select ord, ask.src, ask.dst, coalesce(value, 0) as value from ask left join r on ask.src = r.src and ask.dst = r.dst")
def _(spark, d):
    return g.fetch_edges(ratings(spark, d), _asked(spark, d))


@query("remove_edges", f"with {R} {_ASK} select src, dst, value from r where not exists (select 1 from ask where ask.src = r.src and ask.dst = r.dst)")
def _(spark, d):
    return g.remove_edges(ratings(spark, d), _asked(spark, d)).select("src", "dst", "value")


@query("remove_edges_hetero", f"with {R} {_ASK} select dst src, src dst, value from r where not exists (select 1 from ask where ask.src = r.src and ask.dst = r.dst)")
def _(spark, d):
    graph = HeteroGraph({"user": customers(spark, d), "item": parts(spark, d)}, {("user", "item"): ratings(spark, d)})
    return graph.remove_edges(("item", "user"), g.transpose(_asked(spark, d)))["item", "user"].select("src", "dst", "value")


@query("drop_unseen_nodes", f"with {R} select p_partkey id from part where p_partkey in (select dst from r)")
def _(spark, d):
    return g.drop_unseen(parts(spark, d), ratings(spark, d), "dst")


@query("densify_ids", f"with {R}, f as (select dst src, src dst, value from r), u as (select src, cast(row_number() over (order by src) - 1 as int) s from (select distinct src from f)), i as (select dst, cast(row_number() over (order by dst) - 1 as int) t from (select distinct dst from f)) select s src, t dst, value from f join u using (src) join i using (dst)")
def _(spark, d):
    return g.densify(g.transpose(ratings(spark, d)))


@query("is_submatrix", f"with {R} {_ASK} select count(*) n_missing, count(*) = 0 is_submatrix from r where exists (select 1 from ask where ask.src = r.src and ask.dst = r.dst)")
def _(spark, d):
    rated = ratings(spark, d)
    return g.is_submatrix(rated, g.remove_edges(rated, _asked(spark, d)))


@query("check_equal", f"with {R}, x as (select src, dst, min(cast(ceil(q / 10) as int)) as value from raw group by src, dst) select 2 * count(*) n_different, count(*) = 0 equal from r join x using (src, dst) where r.value <> x.value")
def _(spark, d):
    least = g.build_graph(raw(spark, d).select("src", "dst", F.ceil(F.col("q") / 10).cast("int").alias("value")), "min")
    return g.differences(ratings(spark, d), least)


@query("from_coordinates", f"with {R} select src, dst, value from r")
def _(spark, d):
    return g.from_coordinates(g.edge_list(ratings(spark, d), customers(spark, d), parts(spark, d)), customers(spark, d), parts(spark, d))


@query("neighbors", f"with {R} select src, dst, value from r where src in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(spark, d):
    return g.neighbors(ratings(spark, d), builders(spark, d)).select("src", "dst", "value")


@query("check_consistency", f"with {R}, x as (select src, dst, min(cast(ceil(q / 10) as int)) as value from raw group by src, dst) select count(*) n_mismatch from r join x using (src, dst) where r.value <> x.value")
def _(spark, d):
    least = g.build_graph(raw(spark, d).select("src", "dst", F.ceil(F.col("q") / 10).cast("int").alias("value")), "min")
    return g.mismatches(ratings(spark, d), g.transpose(least))


@query("check_duplicates", "select src, dst, count(*) n from (select o_custkey src, l_partkey dst from lineitem join orders on l_orderkey = o_orderkey) group by 1, 2 having count(*) > 1")
def _(spark, d):
    return g.repeated_edges(raw(spark, d))


@query("check_contiguous", "select count(*) n, min(c_custkey) = 0 and max(c_custkey) = count(*) - 1 and count(distinct c_custkey) = count(*) contiguous from customer")
def _(spark, d):
    return g.contiguous(customers(spark, d))


@query("unique_counts", "select l_suppkey as value, count(*) n from lineitem group by 1")
def _(spark, d):
    return g.unique_counts(table(spark, d, "lineitem"), "l_suppkey")


@query("unique_inverse", "with f as (select o_custkey, min(o_orderkey) first from orders group by 1), p as (select o_custkey, cast(row_number() over (order by first) - 1 as int) place from f) select o_orderkey ord, o_custkey as value, place from orders join p using (o_custkey)")
def _(spark, d):
    return g.unique_inverse(table(spark, d, "orders"), "o_orderkey", "o_custkey").select("ord", "value", F.col("place").cast("int"))


_MERGE = "u as (select 'a' source, c_custkey id from customer where c_mktsegment = 'BUILDING' union all select 'b', c_custkey from customer where c_nationkey < 5), p as (select id, cast(row_number() over (order by id) - 1 as int) place from (select distinct id from u))"


@query("merge_nodes", f"with {_MERGE} select source, id, place from u join p using (id)")
def _(spark, d):
    other = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))
    return g.merge_nodes({"a": builders(spark, d), "b": other})


@query("merge_node_ids", "with u as (select 'user' as type, 'order' source, o_custkey id from orders where o_orderstatus = 'F' union all select 'user', 'segment', c_custkey from customer where c_mktsegment = 'BUILDING' union all select 'item', 'size', p_partkey from part where p_size <= 10), p as (select type, id, cast(row_number() over (partition by type order by id) - 1 as int) place from (select distinct type, id from u)) select type, source, id, place from u join p using (type, id)")
def _(spark, d):
    row = lambda df, kind, source, c: df.select(F.lit(kind).alias("type"), F.lit(source).alias("source"), F.col(c).alias("id"))
    a = row(table(spark, d, "orders").where("o_orderstatus = 'F'"), "user", "order", "o_custkey")
    return g.merge_typed_nodes(a.unionByName(row(builders(spark, d), "user", "segment", "id")).unionByName(row(small_parts(spark, d), "item", "size", "id")))


_BOTH = ", b as (select src * 2 src, dst * 2 + 1 dst from r union all select dst * 2 + 1, src * 2 from r)"


def both_ways(edges: DataFrame) -> DataFrame:
    """A bipartite graph as one of nodes: users get even, items odd numbers."""
    forth = edges.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    return forth.unionByName(g.transpose(forth))


@query("khop_frontier", f"with {R} {_BOTH}, h0 as (select c_custkey * 2 id from customer where c_acctbal > 9900), h1 as (select id from h0 union select dst from b join h0 on src = id), h2 as (select id from h1 union select dst from b join h1 on src = id) select id from h2")
def _(spark, d):
    seeds = table(spark, d, "customer").where("c_acctbal > 9900").select((F.col("c_custkey") * 2).alias("id"))
    return g.expand_frontier(both_ways(ratings(spark, d)), seeds, 2)


@query("meta_graph_matrix", f"with {R}, x as (select distinct l_suppkey src, l_partkey dst from lineitem) select 'user' src_type, 'item' dst_type, count(*) nnz, count(distinct value) n_link_types from r union all select 'item', 'user', count(*), count(distinct value) from r union all select 'supplier', 'item', count(*), 1 from x union all select 'item', 'supplier', count(*), 1 from x")
def _(spark, d):
    supply = g.build_graph(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1).alias("value")), "max")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return HeteroGraph({"user": customers(spark, d), "item": parts(spark, d), "supplier": suppliers}, {("user", "item"): ratings(spark, d), ("supplier", "item"): supply}).summary()


# Segments: reductions, broadcasts, softmax, pools and gradients.

_V = E + ", v as (select src seg, dst pos, value from e)"
for _how, _out in (("sum", "coalesce(sum(v.value), 0)"), ("avg", "round(coalesce(avg(v.value), 0), 6)"), ("min", "min(v.value)"), ("max", "max(v.value)")):

    def _reduce(spark, d, how=_how):
        out = seg.reduce(values(spark, d), segments(spark, d), how)
        return out.select("seg", (F.round("value", 6) if how == "avg" else F.col("value")).alias("value"))

    query(f"seg_{_how}", f"with {_V} select c_custkey seg, {_out} as value from customer left join v on seg = c_custkey group by 1")(_reduce)


@query("seg_sum_batched", f"with {_V}, k as (select unnest(range(3)) k) select cast(k as int) k, c_custkey seg, coalesce(sum(v.value * (k + 1)), 0) as value from k cross join customer left join v on seg = c_custkey group by 1, 2")
def _(spark, d):
    ks = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")
    data = values(spark, d).select("seg", "value", ks).withColumn("value", F.col("value") * (F.col("k") + 1))
    return seg.reduce(data, segments(spark, d).select("seg", ks), "sum", ("k", "seg"))


for _op, _f in (("add", "v.value + c_acctbal"), ("sub", "v.value - c_acctbal"), ("mul", "v.value * c_acctbal"), ("div", "v.value / c_acctbal"), ("to", "c_acctbal")):

    def _cast(spark, d, op=_op):
        right = table(spark, d, "customer").select(F.col("c_custkey").alias("seg"), F.col("c_acctbal").alias("value"))
        return seg.broadcast(values(spark, d), right, op).select("seg", "pos", scalars.rounded(F.col("value"), 6).alias("value"))

    query(f"seg_broadcast_{_op}", f"with {_V} select seg, pos, round({_f}, 6) + 0.0 as value from v join customer on c_custkey = seg")(_cast)

_SOFT = _V + ", m as (select *, exp(value - max(value) over (partition by seg)) x from v), p as (select seg, pos, value, x / sum(x) over (partition by seg) p from m)"


@query("seg_softmax", f"with {_SOFT} select seg, pos, round(p, 6) + 0.0 as value from p")
def _(spark, d):
    return seg.softmax(values(spark, d)).select("seg", "pos", F.round("value", 6).alias("value"))


@query("seg_softmax_grad", f"with {_SOFT} select seg, pos, round(p * (value - sum(p * value) over (partition by seg)), 6) + 0.0 as value from p")
def _(spark, d):
    data = values(spark, d)
    return seg.softmax_grad(seg.softmax(data), data).select("seg", "pos", F.round("value", 6).alias("value"))


@query("seg_broadcast_mul_grad", f"with {_V} select c_custkey seg, coalesce(sum(v.value * v.value), 0) as value from customer left join v on seg = c_custkey group by 1")
def _(spark, d):
    data = values(spark, d)
    return seg.broadcast_mul_grad(data, data, segments(spark, d))


_POOL = R + SUP + ", m as (select src seg, dst pos, support, embedding from s join embeddings on vec_id = dst % (select count(*) from embeddings)), x as (select seg, pos, support, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from m), grid as (select c_custkey seg, unnest(range(64)) i from customer)"
for _name, _how, _weight, _f in (("seg_pool_sum", "sum", None, "sum(v)"), ("seg_pool_avg", "avg", None, "avg(v)"), ("seg_pool_max", "max", None, "max(v)"), ("seg_pool_min", "min", None, "min(v)"), ("seg_weighted_pool", "sum", "support", "sum(v * support)")):

    def _pool(spark, d, how=_how, weight=_weight):
        return seg.pool(members(spark, d), vectors(spark, d), segments(spark, d), how, DIM, weight, 4).select("seg", F.col("i").cast("long"), "value")

    query(_name, f"with {_POOL} select grid.seg, grid.i, round(coalesce({_f}, 0), 4) + 0.0 as value from grid left join x on grid.seg = x.seg and grid.i = x.i group by 1, 2")(_pool)


@query("seg_argmax", f"with {_POOL} select seg, i, arg_max(pos, (v, -pos)) pos from x group by 1, 2")
def _(spark, d):
    return seg.max_pool_winner(members(spark, d), vectors(spark, d), DIM).select("seg", F.col("i").cast("long"), "pos")


def user_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(seg, id, vector): a customer's vector, as the gradient or embedding of its segment."""
    n = n_vectors(spark, d)
    keyed = customers(spark, d).select(F.col("id").alias("seg"), (F.col("id") % n).alias("id"))
    return keyed.join(vectors(spark, d), "id").select("seg", "vector")


_ENDS = R + ", j as (select src, dst, a.embedding::double[] a, b.embedding::double[] b from r join embeddings a on a.vec_id = src % (select count(*) from embeddings) join embeddings b on b.vec_id = dst % (select count(*) from embeddings))"


def _ended(spark, d):
    left = user_vectors(spark, d).withColumnRenamed("seg", "id")
    n = n_vectors(spark, d)
    right = parts(spark, d).select(F.col("id").alias("key"), (F.col("id") % n).alias("id")).join(vectors(spark, d), "id").select(F.col("key").alias("id"), "vector")
    return ratings(spark, d).select("src", "dst"), left, right


@query("edge_inner_product", f"with {_ENDS} select src, dst, round(list_dot_product(a, b), 4) + 0.0 as value from j")
def _(spark, d):
    return seg.inner_product(*_ended(spark, d)).select("src", "dst", F.round("value", 4).alias("value"))


@query("edge_sq_distance", f"with {_ENDS} select src, dst, round(list_dot_product(a, a) - 2 * list_dot_product(a, b) + list_dot_product(b, b), 4) + 0.0 as value from j")
def _(spark, d):
    return seg.squared_distance(*_ended(spark, d)).select("src", "dst", F.round("value", 4).alias("value"))


_GRAD = R + SUP + ", nv as (select count(*) n from embeddings), u as (select c_custkey seg, embedding from customer join embeddings on vec_id = c_custkey % (select n from nv)), y as (select src seg, dst pos, dst % (select n from nv) id, support, 1.0::double / count(*) over (partition by src) share from s)"
for _name, _avg, _weight, _w in (("seg_pool_grad", False, None, "1"), ("seg_pool_grad_avg", True, None, "share"), ("seg_weighted_pool_grad_data", False, "support", "support")):

    def _back(spark, d, average=_avg, weight=_weight):
        out = seg.pool_grad(members(spark, d), user_vectors(spark, d), vectors(spark, d).select(F.col("id").alias("seg")), DIM, average, weight)
        return out.select(F.col("seg").alias("id"), F.col("i").cast("long"), F.round("value", 4).alias("value"))

    query(_name, f"with {_GRAD}, x as (select id, {_w} w, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from y join u using (seg)), grid as (select vec_id id, unnest(range(64)) i from embeddings) select grid.id, grid.i, round(coalesce(sum(v * w), 0), 4) + 0.0 as value from grid left join x on grid.id = x.id and grid.i = x.i group by 1, 2")(_back)


@query("seg_weighted_pool_grad_weights", f"with {_ENDS} select src seg, dst pos, round(list_dot_product(a, b), 4) + 0.0 as value from j")
def _(spark, d):
    return seg.inner_product(*_ended(spark, d)).select(F.col("src").alias("seg"), F.col("dst").alias("pos"), F.round("value", 4).alias("value"))


@query("seg_max_pool_grad", f"with {_POOL}, won as (select seg, i, arg_max(pos, (v, -pos)) pos from x group by 1, 2), gr as (select c_custkey seg, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from customer join embeddings on vec_id = c_custkey % (select count(*) from embeddings)) select pos % (select count(*) from embeddings) id, i, round(sum(v), 4) + 0.0 as value from won join gr using (seg, i) group by 1, 2")
def _(spark, d):
    m = members(spark, d)
    out = seg.max_pool_grad(m, seg.max_pool_winner(m, vectors(spark, d), DIM), user_vectors(spark, d))
    return out.select("id", F.col("i").cast("long"), F.round(F.col("value").cast("double"), 4).alias("value"))


# Sampling, negatives, walks.


@query("sample_neighbors_k", f"with {R} select src, dst, value from (select *, {RANK.format(0)} k from r) where k <= 5")
def _(spark, d):
    return s.sample_neighbors(ratings(spark, d), 5).select("src", "dst", "value")


@query("sample_submat", f"with {R}, c as (select src, dst, value from (select *, {RANK.format(1)} k from r) where k <= 2), i as (select dst, cast(row_number() over (order by dst) - 1 as int) dst_ind from (select distinct dst from c)) select src, dst, value, dst_ind from c join i using (dst)")
def _(spark, d):
    return s.sample_submatrix(ratings(spark, d), 2, 1).select("src", "dst", "value", "dst_ind")


@query("sample_neighbors", f"with {R} {SUP} select src, dst, value, round(support, 6) support from (select *, {RANK.format(2)} k from s) where k <= 5")
def _(spark, d):
    return s.sample_with_support(ratings(spark, d), 5, 2).select("src", "dst", "value", F.round("support", 6).alias("support"))


_SEEDS = ", t as (select c_custkey id from customer where c_mktsegment = 'BUILDING')"


@query("sample_and_merge", f"with {R} {_SEEDS}, k as (select src, dst, {RANK.format(3)} k, greatest(round(count(*) over (partition by src) * 0.1), 15) most from r where src in (select id from t)), u as (select id from t union select dst from k where k <= most) select id, cast(row_number() over (order by id) - 1 as int) ind from u")
def _(spark, d):
    return s.sample_and_merge(ratings(spark, d), builders(spark, d), 0.1, 15, 3)


@query("uniform_choice_range", f"select c_custkey as key, cast(t as int) draw, {DRAW.format('4, c_custkey, t', 'c_nationkey')} as value from customer, range(3) r(t) where c_nationkey > 0")
def _(spark, d):
    return s.choices(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey"), 3, F.col("c_nationkey"), 4)


@query("uniform_choice_set", "select key, cast(k - 1 as int) draw, x as value from (select c_custkey as key, x, row_number() over (partition by c_custkey order by md5(concat_ws(':', 4, c_custkey, x)), x) k from customer, range(25) r(x) where x < c_nationkey) where k <= 3")
def _(spark, d):
    out = s.choices(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey"), 3, F.col("c_nationkey"), 4, replace=False)
    return out.select("key", F.col("draw").cast("int"), "value")


_NEG = f""", deg as (select src id, count(*) degree from r group by 1), np as (select count(*) n from part),
need as (select id, degree, least(ceil(degree * 0.5), (select n from np) - degree)::bigint want from deg),
tries as (select id, unnest(range(0, 2 * want + 16)) t from need where want > 0),
drawn as (select id, {DRAW.format('5, id, t', '(select n from np)')} other, min(t) t from tries group by 1, 2),
fresh as (select * from drawn where not exists (select 1 from r where src = id and dst = other)),
short as (select id from need left join (select id, count(*) have from fresh group by 1) using (id) where coalesce(have, 0) < want),
alls as (select * from fresh where id not in (select id from short) union all
  select id, x, 0 from short, range((select n from np)) a(x) where not exists (select 1 from r where src = id and dst = x))
select id, other from (select *, row_number() over (partition by id order by t, md5(concat_ws(':', 5, id, other)), other) k from alls) join need using (id) where k <= want"""


@query("uniform_neg_sampling", f"with {R} {_NEG}")
def _(spark, d):
    rated = ratings(spark, d)
    targets = rated.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return s.negatives(rated, targets, parts(spark, d).count(), F.col("degree") * 0.5, 5)


@query("labelled_pairs", f"with {R} {_NEG.replace('select id, other from (select *, row', 'select id, other, 0 as label from (select *, row')} union all select src, dst, 1 from r")
def _(spark, d):
    rated = ratings(spark, d)
    targets = rated.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return s.labelled_pairs(rated, targets, parts(spark, d).count(), F.col("degree") * 0.5, 5)


_SAME = f""", nn as (select (select count(*) from customer) nr, (select count(*) from part) nc),
tries as (select src, dst, {DRAW.format("'6/coin', src, dst", 2)} coin, t, {DRAW.format("'6/row', src, dst, t", '(select nr from nn)')} rr, {DRAW.format("'6/col', src, dst, t", '(select nc from nn)')} cc from r, range(24) a(t)),
drawn as (select src, dst, t, case when t >= 8 or coin = 1 then rr else src end new_src, case when t >= 8 or coin = 0 then cc else dst end new_dst from tries),
fresh as (select * from drawn where not exists (select 1 from r where r.src = new_src and r.dst = new_dst))
select src, dst, new_src, new_dst from (select *, row_number() over (partition by src, dst order by t) k from fresh) where k = 1"""


@query("neg_edges_same_node", f"with {R} {_SAME}")
def _(spark, d):
    return s.negatives_same_node(ratings(spark, d), customers(spark, d).count(), parts(spark, d).count(), 6)


@query("neg_edges_all", f"""with {R}, n as (select (select count(*) from customer) nr, (select count(*) from part) nc, round_even(count(*) * 0.1, 0)::bigint n from r),
drawn as (select draw, {DRAW.format("'7/row', draw", '(select nr from n)')} src, {DRAW.format("'7/col', draw", '(select nc from n)')} dst from (select unnest(range(0, (select 2 * n + 64 from n))) draw)),
kept as (select * from drawn where not exists (select 1 from r where r.src = drawn.src and r.dst = drawn.dst))
select draw, src, dst from (select *, row_number() over (order by draw) k from kept) where k <= (select n from n)""")
def _(spark, d):
    rated = ratings(spark, d)
    return s.negatives_all(rated, customers(spark, d).count(), parts(spark, d).count(), round(rated.count() * 0.1), 7)


def _walk_sql(back: float) -> str:
    move = DRAW.format("'8/move', walk, step + 1", "n")
    home = DRAW.format("'8/back', walk, step + 1", 1_000_000)
    return f"""with recursive {R} {_BOTH}, nb as (select src, dst, row_number() over (partition by src order by dst) - 1 k, count(*) over (partition by src) n from b),
cnt as (select distinct src, n from nb),
w as (select c_custkey walk, c_custkey * 2 start, c_custkey * 2 node, 0 step from customer
 union all select walk, start, case when home then start else nb.dst end, step + 1
 from (select w.*, n, {move} k, {home} < {int(back * 1_000_000)} home from w join cnt on node = cnt.src where step < 4) x join nb on nb.src = x.node and nb.k = x.k)"""


@query("random_walk_nodes", _walk_sql(0) + " select walk, cast(step as int) step, node from w")
def _(spark, d):
    starts = customers(spark, d).select(F.col("id").alias("walk"), (F.col("id") * 2).alias("node"))
    return s.random_walks(both_ways(ratings(spark, d)), starts, 4, 8)


@query("random_walk_restart", _walk_sql(0.3) + ", f as (select walk, node, min(step) step from w group by 1, 2) select walk, node, cast(step as int) step from (select *, row_number() over (partition by walk order by step, node) k from f) where k <= 3")
def _(spark, d):
    starts = customers(spark, d).select(F.col("id").alias("walk"), (F.col("id") * 2).alias("node"))
    return s.capped_nodes(s.random_walks(both_ways(ratings(spark, d)), starts, 4, 8, 0.3), 3).select("walk", "node", "step")


# Splits and batches.

_T = R + ", n as (select count(*) n, ceil(count(*) * 0.1)::bigint t from r), k as (select *, row_number() over (order by md5(concat_ws(':', 9, src, dst)), src, dst) k from r), sp as (select src, dst, value, case when k <= (select t from n) then 'test' when k <= (select t + ceil((n - t) * 0.1)::bigint from n) then 'valid' else 'train' end split from k)"


@query("split_transductive", f"with {_T} select * from sp")
def _(spark, d):
    return splits.transductive(ratings(spark, d), 0.1, 0.1, 9).select("src", "dst", "value", "split")


@query("split_summary", f"with {_T} select split, count(*) n_edges, count(distinct src) n_src, count(distinct dst) n_dst from sp group by 1")
def _(spark, d):
    return splits.split_summary(splits.transductive(ratings(spark, d), 0.1, 0.1, 9))


@query("split_graphs", f"with {_T} select g.graph, count(*) n, sum(value)::bigint total from sp join (values ('all', 'test'), ('all', 'valid'), ('all', 'train'), ('test', 'valid'), ('test', 'train'), ('valid', 'train'), ('train', 'train')) g(graph, split) using (split) group by 1")
def _(spark, d):
    made = splits.split_graphs(splits.transductive(ratings(spark, d), 0.1, 0.1, 9))
    rows = None
    for name, edges in made.items():
        one = edges.agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total")).select(F.lit(name).alias("graph"), "n", "total")
        rows = one if rows is None else rows.unionByName(one)
    return rows


_IND = R + ", dg as (select c_custkey id, cast(count(src) as int) degree from customer left join r on src = c_custkey group by 1), many as (select id, row_number() over (order by md5(concat_ws(':', 10, id)), id) k from dg where degree > 10), nd as (select dg.id, degree, coalesce(k <= (select ceil(count(*) * 20 / 100.0) from dg), false) held from dg left join many on dg.id = many.id)"


@query("split_inductive", f"with {_IND} select id, degree, held from nd")
def _(spark, d):
    return splits.inductive_nodes(g.degrees(ratings(spark, d), customers(spark, d)), 20, 10)


@query("split_inductive_edges", f"with {_IND} select src, dst, value from (select r.*, {RANK.format(10)} k, floor(degree * 90 / 100.0) most from r join nd on src = id where held) where k <= most")
def _(spark, d):
    rated = ratings(spark, d)
    nodes = splits.inductive_nodes(g.degrees(rated, customers(spark, d)), 20, 10)
    return splits.inductive_edges(rated, nodes, 90, 10).select("src", "dst", "value")


@query("inductive_graphs", f"with {_IND}, hv as (select id, row_number() over (order by md5(concat_ws(':', 15, id)), id) k from nd where not held and degree > 10), n2 as (select nd.id, degree, coalesce(k <= (select ceil(count(*) * 20 / 100.0) from nd where not held), false) held from nd left join hv on nd.id = hv.id where not nd.held), vp as (select src, dst from (select r.*, {RANK.format(15)} k, floor(degree * 90 / 100.0) most from r join n2 on src = id where held) where k <= most) select 'valid' graph, src, dst, value from r where src in (select id from n2) and (src, dst) not in (select src, dst from vp) union all select 'train', src, dst, value from r where src in (select id from n2 where not held)")
def _(spark, d):
    rated = ratings(spark, d)
    seen = splits.inductive_nodes(g.degrees(rated, customers(spark, d)), 20, 10).where("not held").drop("held")
    again = splits.inductive_nodes(seen, 20, 15)
    made = splits.inductive_graphs(rated, again.where("not held"), again.where("held"), splits.inductive_edges(rated, again, 90, 15))
    valid, train = (made[k].select(F.lit(k).alias("graph"), "src", "dst", "value") for k in ("valid", "train"))
    return valid.unionByName(train)


@query("rating_batches", f"with {R}, k as (select src, dst, row_number() over (order by md5(concat_ws(':', '11/0', src, dst)), src, dst) k from r) select src, dst, floor((k - 1) / 1000.0)::bigint batch from k")
def _(spark, d):
    return splits.batches(ratings(spark, d), 1000, False, 11).select("src", "dst", "batch")


@query("rating_batches_sequential", f"with {R}, k as (select src, dst, row_number() over (order by src, dst) k from r) select src, dst, floor((k - 1) / 1000.0)::bigint batch from k")
def _(spark, d):
    return splits.batches(ratings(spark, d), 1000).select("src", "dst", "batch")


@query("recon_mask", "with k as (select c_custkey id, row_number() over (order by md5(concat_ws(':', 12, c_custkey)), c_custkey) k from customer), n as (select ceil(count(*) * 0.2) n from customer) select id, k <= (select n from n) chosen, case when not (k <= (select n from n) and ('0x' || substr(md5(concat_ws(':', '12/mask', id)), 1, 8))::bigint / 4294967296.0 < 0.9) then id end mapped from k")
def _(spark, d):
    return splits.reconstruction_mask(customers(spark, d), 0.2, 0.9, 12)


@query("eval_noise", "select c_custkey id, case when c_mktsegment = 'BUILDING' then c_custkey end mapped from customer")
def _(spark, d):
    return splits.evaluation_map(customers(spark, d), builders(spark, d))


@query("remove_batch_edges", f"with {R}, k as (select *, row_number() over (order by md5(concat_ws(':', '11/0', src, dst)), src, dst) k from r), rest as (select src, dst from k where k > 1000) select src, dst, round(sqrt(1.0 / count(*) over (partition by src) / count(*) over (partition by dst)), 6) support from rest")
def _(spark, d):
    rated = ratings(spark, d)
    batch = splits.batches(rated, 1000, False, 11).where("batch = 0")
    return g.with_support(g.remove_edges(rated, batch)).select("src", "dst", F.round("support", 6).alias("support"))


@query("masked_embedding", "with n as (select count(*) n from embeddings) select c_custkey id, i, round(case when c_mktsegment = 'BUILDING' then embedding[(i + 1)::int] else 0 end::double, 6) + 0.0 as value from customer join embeddings on vec_id = c_custkey % (select n from n), range(64) a(i)")
def _(spark, d):
    known = splits.evaluation_map(customers(spark, d), builders(spark, d))
    held = user_vectors(spark, d).withColumnRenamed("seg", "mapped")
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    found = known.join(held, "mapped", "left").select("id", F.posexplode(F.coalesce("vector", zero)).alias("i", "value"))
    return found.select("id", F.col("i").cast("long"), F.round(F.col("value").cast("double"), 6).alias("value"))


# Scalars and features.

_TITLE = "select p_partkey id, case when p_size > 25 then p_name || ' (' || (1950 + p_size) || ')' else p_name end title from part"


def titles(spark: SparkSession, d: str) -> DataFrame:
    year = F.concat(F.col("p_name"), F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, year).otherwise(F.col("p_name")).alias("title"))


@query("title_year", f"with t as ({_TITLE}) select id, case when regexp_matches(title, '^(.+)\\s*\\((\\d+)\\)') then regexp_extract(title, '^(.+)\\s*\\((\\d+)\\)', 1) else title end name, case when regexp_matches(title, '^(.+)\\s*\\((\\d+)\\)') then regexp_extract(title, '^(.+)\\s*\\((\\d+)\\)', 2)::int else 1950 end as year from t")
def _(spark, d):
    t = F.col("title")
    return titles(spark, d).select("id", scalars.title_text(t).alias("name"), scalars.title_year(t).alias("year"))


def _domain(df: DataFrame, column: str) -> list[str]:
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


@query("one_hot", "with v as (select c_mktsegment, row_number() over (order by c_mktsegment) - 1 i from (select distinct c_mktsegment from customer)) select c_custkey id, v.i, (customer.c_mktsegment = v.c_mktsegment)::int::double as value from customer cross join v")
def _(spark, d):
    df = table(spark, d, "customer")
    hot = scalars.one_hot(F.col("c_mktsegment"), _domain(df, "c_mktsegment"))
    return df.select(F.col("c_custkey").alias("id"), F.posexplode(hot).alias("i", "value")).select("id", F.col("i").cast("long"), F.col("value").cast("double"))


@query("genre_flags", "with gv as (select * from (values (0, 'Children'), (1, 'Drama'), (2, 'unknown')) t(i, g)), x as (select p_partkey id, case p_size % 4 when 0 then 'Children''s|Drama' when 1 then 'Drama' when 2 then 'Noir' else 'Childrens|Noir' end gs from part), y as (select id, list_transform(string_split(gs, '|'), lambda z: case when z in ('Children''s', 'Childrens') then 'Children' else z end) l from x) select id, i, (list_contains(l, g) or (g = 'unknown' and len(list_filter(l, lambda z: z not in ('Children', 'Drama', 'unknown'))) > 0))::int as value from y cross join gv")
def _(spark, d):
    n = F.col("p_size") % 4
    genres = F.when(n == 0, "Children's|Drama").when(n == 1, "Drama").when(n == 2, "Noir").otherwise("Childrens|Noir")
    flags = scalars.genre_flags(genres, ["Children", "Drama", "unknown"])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(flags).alias("i", "value"))


@query("user_features", "with v as (select c_mktsegment, row_number() over (order by c_mktsegment) + 1 i from (select distinct c_mktsegment from customer)) select c_custkey id, 0 i, round(c_nationkey / 50.0, 6)::double as value from customer union all select c_custkey, 1, (c_acctbal < 0)::int from customer union all select c_custkey, v.i, (customer.c_mktsegment = v.c_mktsegment)::int from customer cross join v")
def _(spark, d):
    df = table(spark, d, "customer")
    hot = scalars.one_hot(F.col("c_mktsegment"), _domain(df, "c_mktsegment"))
    made = F.concat(F.array(F.round(F.col("c_nationkey") / 50.0, 6), (F.col("c_acctbal") < 0).cast("double")), hot.cast("array<double>"))
    return df.select(F.col("c_custkey").alias("id"), F.posexplode(made).alias("i", "value")).select("id", F.col("i").cast("long"), "value")


_TOK = "tok as (select p_partkey id, unnest(string_split(lower(p_name), ' ')) token from part), tv as (select tok.id, embedding from tok join embeddings on vec_id = " + DRAW.format("'13', token", "(select count(*) from embeddings)") + "), tx as (select id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from tv)"


def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    return tokens.select("token", s.draw(13, "token", below=n_vectors(spark, d)).alias("id")).join(vectors(spark, d), "id").select("token", "vector")


@query("title_embedding", f"with {_TOK} select id, i, round(avg(v), 4) + 0.0 as value from tx group by 1, 2")
def _(spark, d):
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    out = scalars.token_means(texts, token_vectors(spark, d), DIM)
    return out.select("id", F.posexplode("vector").alias("i", "value")).select("id", F.col("i").cast("long"), F.round("value", 4).alias("value"))


@query("item_features", f"with {_TOK}, m as (select id, i, round(avg(v), 4) + 0.0 as value from tx group by 1, 2) select id, i, value from m union all select p_partkey, 64, round((1950 + p_size - 1950) / 100.0, 6)::double from part")
def _(spark, d):
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    out = scalars.token_means(texts, token_vectors(spark, d), DIM).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    made = F.concat(F.transform("vector", lambda v: F.round(v, 4)), F.array(F.round(scalars.scaled_year(F.lit(1950) + F.col("p_size")), 6)))
    return out.select("id", F.posexplode(made).alias("i", "value")).select("id", F.col("i").cast("long"), "value")


_ACTS = {"leaky": "case when x > 0 then x else 0.1 * x end", "identity": "x", "elu": "case when x > 0 then x else exp(x) - 1 end", "relu": "greatest(x, 0)", "sigmoid": "1 / (1 + exp(-x))", "tanh": "tanh(x)", "softrelu": "greatest(x, 0) + ln(1 + exp(-abs(x)))", "softsign": "x / (1 + abs(x))"}


@query("activations", "with t as (select c_custkey id, c_acctbal / 1000 x from customer) select id, " + ", ".join(f"round({f}, 6) {n}" for n, f in _ACTS.items()) + " from t")
def _(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x"))
    return t.select("id", *[F.round(scalars.activation(n, F.col("x")), 6).alias(n) for n in _ACTS])


@query("pair_key", "select distinct concat_ws(':', least(o_custkey, o_orderkey), greatest(o_custkey, o_orderkey)) as key from orders")
def _(spark, d):
    return table(spark, d, "orders").select(g.pair_key(F.col("o_custkey"), F.col("o_orderkey")).alias("key")).distinct()


@query("normalize_features", "with x as (select vec_id id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from embeddings) select id, i, round((v - avg(v) over (partition by i)) / case when stddev_pop(v) over (partition by i) = 0 then 1 else stddev_pop(v) over (partition by i) end, 4) + 0.0 as value from x")
def _(spark, d):
    out = scalars.normalize_vectors(vectors(spark, d), DIM)
    return out.select("id", F.posexplode("vector").alias("i", "value")).select("id", F.col("i").cast("long"), F.round("value", 4).alias("value"))


# Evaluation and networks.


@query("rating_stats", f"with {R} select round(avg(value), 6) mean, round(stddev_pop(value), 6) std from r")
def _(spark, d):
    return evaluate.rating_stats(ratings(spark, d)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("standardize", f"with {R} select src, dst, round((value - avg(value) over ()) / stddev_pop(value) over (), 6) + 0.0 as value from r")
def _(spark, d):
    rated = ratings(spark, d)
    # One row of statistics is broadcast.
    return rated.crossJoin(F.broadcast(evaluate.rating_stats(rated))).select("src", "dst", F.round(scalars.standardize(F.col("value"), F.col("mean"), F.col("std")), 6).alias("value"))


_PRED = _ENDS + ", p as (select src, dst, list_dot_product(a, b) prediction from j)"


@query("predict_rating", f"with {_PRED} select src, dst, round(prediction, 4) + 0.0 prediction from p")
def _(spark, d):
    return network.predict(*_ended(spark, d)).select("src", "dst", F.round("value", 4).alias("prediction"))


def _predicted(spark, d):
    p = network.predict(*_ended(spark, d)).select("src", "dst", F.col("value").alias("prediction"))
    return p.join(ratings(spark, d).withColumnRenamed("value", "truth"), ["src", "dst"])


@query("rmse_clipped", f"with {_PRED} select round(sqrt(avg(pow(greatest(least(prediction, 5), 1) - value, 2))), 6) rmse from p join r using (src, dst)")
def _(spark, d):
    return evaluate.rmse(_predicted(spark, d), 1.0, 5.0).select(F.round("rmse", 6).alias("rmse"))


@query("rmse_unclipped", f"with {_PRED} select round(sqrt(avg(pow(prediction - value, 2))), 6) rmse from p join r using (src, dst)")
def _(spark, d):
    return evaluate.rmse(_predicted(spark, d)).select(F.round("rmse", 6).alias("rmse"))


@query("losses", f"with {_PRED}, x as (select avg(pow(prediction - value, 2)) / 2 a, avg(pow(prediction, 2)) b from p join r using (src, dst)) select round(a, 6) rating_loss, round(b, 6) reconstruction_loss, round(a + 0.1 * b, 6) loss from x")
def _(spark, d):
    rows = _predicted(spark, d).withColumn("reconstruction", F.col("prediction") * F.col("prediction"))
    out = evaluate.losses(rows, 0.1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("global_norm", "with x as (select unnest(embedding)::double v from embeddings), n as (select sqrt(sum(v * v)) n from x) select round(n, 6) norm, round(least(1.0, 10.0 / n), 6) factor from n")
def _(spark, d):
    flat = vectors(spark, d).select(F.explode("vector").alias("value")).select(F.col("value").cast("double"))
    return evaluate.global_norm(flat, 10.0).select(F.round("norm", 6).alias("norm"), F.round("factor", 6).alias("factor"))


@query("parameter_inventory", "select label::varchar as name, sum(len(embedding))::bigint size from embeddings group by 1")
def _(spark, d):
    flat = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("name"), F.explode("embedding").alias("value"))
    return evaluate.parameter_inventory(flat)


UNITS = 4


def _weights(link: int) -> network.Dense:
    """Fixed weights that SQL can state as well."""
    return network.Dense([[((o * 31 + i * 17 + link * 5) % 13 - 6) / 13 for i in range(DIM)] for o in range(UNITS)], [(o + link) / 10 for o in range(UNITS)])


_W = "((o * 31 + i * 17 + {0} * 5) % 13 - 6) / 13.0::double"
_GCN = R + SUP + f""", m as (select src, value - 1 l, support, embedding from s join embeddings on vec_id = dst % (select count(*) from embeddings)),
x as (select src, l, unnest(embedding)::double * support v, generate_subscripts(embedding, 1) - 1 i from m), px as (select src, l, i, sum(v) v from x group by 1, 2, 3),
ps as (select src, l, sum(support) t from m group by 1, 2),
h as (select src, l, o, sum(v * {_W.format('l')}) v from px, range(4) a(o) group by 1, 2, 3),
hl as (select h.src, h.l, h.o, v + (h.o + h.l) / 10.0::double * t v from h join ps on h.src = ps.src and h.l = ps.l)"""


def _linked(spark, d):
    n = n_vectors(spark, d)
    return g.with_support(ratings(spark, d)).select("src", (F.col("dst") % n).alias("dst"), (F.col("value") - 1).alias("link_id"), "support")


def _long(df: DataFrame, decimals: int = 4) -> DataFrame:
    return df.select("id", F.posexplode("vector").alias("i", "value")).select("id", F.col("i").cast("long"), F.round("value", decimals).alias("value"))


@query("gcn_aggregate", f"with {_GCN}, z as (select c_custkey id, o, coalesce(sum(v), 0) v from (select c_custkey, b.o from customer cross join range(4) b(o)) a left join (select src, o o2, v from hl) h on src = c_custkey and o2 = o group by 1, 2) select id, o i, round(case when v > 0 then v else 0.1 * v end, 4) + 0.0 as value from z")
def _(spark, d):
    return _long(network.Aggregator([_weights(k) for k in range(5)], "sum").apply(_linked(spark, d), vectors(spark, d), customers(spark, d)))


@query("gcn_aggregate_stack", f"with {_GCN}, z as (select c_custkey id, l * 4 + o i, coalesce(sum(v), 0) v from (select c_custkey, b.o o, c.l l from customer cross join range(4) b(o) cross join range(5) c(l)) a left join (select src, o o2, l l2, v from hl) h on src = c_custkey and o2 = o and l2 = l group by 1, 2) select id, i, round(case when v > 0 then v else 0.1 * v end, 4) + 0.0 as value from z")
def _(spark, d):
    return _long(network.Aggregator([_weights(k) for k in range(5)], "stack").apply(_linked(spark, d), vectors(spark, d), customers(spark, d)))


@query("heter_gcn_layer", f"""with {_GCN}, z as (select c_custkey id, o, coalesce(sum(v), 0) v from (select c_custkey, b.o from customer cross join range(4) b(o)) a left join (select src, o o2, v from hl) h on src = c_custkey and o2 = o group by 1, 2),
za as (select id, o, case when v > 0 then v else 0.1 * v end v from z),
ow as (select id, o, sum(v * {_W.format('7')}) + (o + 7) / 10.0::double v from (select c_custkey id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from customer join embeddings on vec_id = c_custkey % (select count(*) from embeddings)) y, range(4) b(o) group by 1, 2),
sm as (select id, o i, za.v + ow.v v from za join ow using (id, o)),
ot as (select id, o, sum(v * (case when i = o then 1.0 else 0.5 end)) v from sm, range(4) b(o) group by 1, 2)
select id, o i, round(case when v > 0 then v else 0.1 * v end, 4) + 0.0 as value from ot""")
def _(spark, d):
    out = network.Dense([[1.0 if i == o else 0.5 for i in range(UNITS)] for o in range(UNITS)])
    layer = network.Layer({"item": network.Aggregator([_weights(k) for k in range(5)])}, out, own=_weights(7))
    own = user_vectors(spark, d).withColumnRenamed("seg", "id")
    own = own.select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    return _long(layer.apply({"item": _linked(spark, d)}, {"item": vectors(spark, d)}, customers(spark, d), own))


_PLAN = R + f""", t as (select src d, dst s, value from r), s0 as (select c_custkey id from customer where c_acctbal > 9900),
e0 as (select src, dst from (select *, {RANK.format('0/0/user')} k from r where src in (select id from s0)) where k <= 5),
i1 as (select distinct dst id from e0),
e1u as (select src, dst from (select *, {RANK.format('0/1/user')} k from r where src in (select id from s0)) where k <= 5),
e1i as (select src, dst from (select *, {RANK.format('0/1/item')} k from (select s src, d dst, value from t) where src in (select id from i1)) where k <= 5)"""


def _plan(spark, d):
    rated = ratings(spark, d)
    seeds = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("id"))
    return network.khop_plan({"user": rated, "item": g.transpose(rated)}, {"user": seeds}, {"user": "item", "item": "user"}, 2, 5)


@query("khop_plan", f"with {_PLAN} select 0 depth, 'user' kind, src, dst from e0 union all select 1, 'user', src, dst from e1u union all select 1, 'item', src, dst from e1i")
def _(spark, d):
    rows = None
    for level in _plan(spark, d):
        for kind, hop in level.items():
            one = hop.edges.select(F.lit(hop.depth).alias("depth"), F.lit(kind).alias("kind"), "src", "dst")
            rows = one if rows is None else rows.unionByName(one)
    return rows


_SAGE = _PLAN.replace(R, R + SUP) + f""", e0s as (select e0.src, e0.dst, support from e0 join s on s.src = e0.src and s.dst = e0.dst),
e1s as (select e1i.src, e1i.dst, support from e1i join s on s.src = e1i.dst and s.dst = e1i.src),
x1 as (select src, i, sum(v) v from (select e1s.src, support * unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from e1s join embeddings on vec_id = e1s.dst % (select count(*) from embeddings)) group by 1, 2),
h1 as (select src id, o, sum(v * {_W.format('0')}) v from x1, range(4) b(o) group by 1, 2),
l1 as (select id, o, case when v > 0 then v else 0.1 * v end v from h1),
x0 as (select e0s.src, o i, sum(support * v) v from e0s join l1 on id = dst group by 1, 2),
h0 as (select src, o, sum(v * case when i = o then 1.0 else 0.25 end) v from x0, range(4) b(o) group by 1, 2)
select id, a.o i, round(case when coalesce(v, 0) > 0 then v else 0.1 * coalesce(v, 0) end, 4) + 0.0 as value from (s0 cross join range(4) a(o)) left join h0 on src = id and h0.o = a.o"""


@query("heter_sage", f"with {_SAGE}")
def _(spark, d):
    n = n_vectors(spark, d)
    base = lambda ids: ids.select("id", (F.col("id") % n).alias("_v")).join(vectors(spark, d).withColumnRenamed("id", "_v"), "_v").select("id", F.col("vector").cast("array<double>").alias("vector"))
    square = network.Dense([[1.0 if i == o else 0.25 for i in range(UNITS)] for o in range(UNITS)])
    layers = [{k: network.Aggregator([m]) for k in ("user", "item")} for m in (square, network.Dense(_weights(0).weight))]
    out = network.run_plan(_plan(spark, d), layers, {"user": "item", "item": "user"}, {"user": base(customers(spark, d)), "item": base(parts(spark, d))})
    return _long(out["user"])


@query("dropout", f"select vec_id id, i, round(case when {DRAW.format("'16', vec_id, i", 1000000)} < 300000 then 0 else embedding[(i + 1)::int]::double / 0.7 end, 4) + 0.0 as value from embeddings, range(64) a(i)")
def _(spark, d):
    return _long(vectors(spark, d).select("id", network.dropout("vector", "id", 0.3, 16).alias("vector")))
