"""Literal fixtures: empty segments, isolated nodes, repeated edges, ties; properties of samples and splits; gradients by differences."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import scalars
from weftgraph.hetero import HeteroGraph
from weftgraph.operators import graph as g
from weftgraph.operators import sampling as s
from weftgraph.operators import segment as seg
from weftgraph.plans import config, evaluate, network, splits, training
from weftgraph.sources import ratings as files
from weftgraph.sources import storage
from weftgraph.streaming.degrees import live_degrees

ROWS = [(10, 1, 4.0), (10, 2, 5.0), (10, 4, 1.0), (20, 1, 3.0), (20, 4, 2.0), (40, 2, 1.0), (40, 2, 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return g.build_graph(spark.createDataFrame(ROWS, "src long, dst long, value double")).cache()


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(i,) for i in (10, 20, 30, 40)], "id long")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")


@pytest.fixture(scope="module")
def item_vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [9.0, 9.0]), (4, [-1.0, 1.0])], "id long, vector array<float>")


@pytest.fixture(scope="module")
def data(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (2, 2, 3.0), (2, 3, 4.0), (2, 4, 5.0), (3, 5, 6.0), (3, 6, 7.0)]
    return spark.createDataFrame(rows, "seg long, pos long, value double")


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(i,) for i in range(4)], "seg long")


def as_map(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_build_and_degrees(edges, users, items):
    assert as_map(edges, "src", "dst")[40, 2]["value"] == 2.0
    assert {r["id"]: r["degree"] for r in g.degrees(edges, users).collect()} == {10: 3, 20: 2, 30: 0, 40: 1}
    assert {r["id"]: r["degree"] for r in g.degrees(edges, items, "dst").collect()} == {1: 2, 2: 2, 3: 0, 4: 2}
    stats = evaluate.rating_stats(edges).first()
    assert round(stats["mean"], 6) == 2.833333 and round(stats["std"], 5) == 1.34371
    assert [r["value"] for r in g.link_types(edges).orderBy("link_id").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_support(edges, spark):
    found = as_map(g.with_support(edges), "src", "dst")
    assert round(found[10, 1]["support"], 6) == 0.408248 and found[20, 4]["support"] == 0.5 and round(found[40, 2]["support"], 6) == 0.707107
    assert round(as_map(g.with_support(edges, False), "src", "dst")[10, 4]["support"], 6) == 0.333333
    left = g.remove_edges(edges, spark.createDataFrame([(10, 4), (99, 1)], "src long, dst long"))
    assert round(as_map(g.with_support(left), "src", "dst")[20, 4]["support"], 6) == 0.707107 and left.count() == 5


def test_fetch_keeps_requests(edges, spark):
    asked = spark.createDataFrame([(0, 10, 1), (1, 30, 1), (2, 10, 1)], "ord int, src long, dst long")
    assert [r["value"] for r in g.fetch_edges(edges, asked).orderBy("ord").collect()] == [4.0, 0.0, 4.0]


def test_csr_round_trip(edges, users):
    csr = g.coo_to_csr(edges, users)
    assert [(r["row"], r["begin"], r["end"]) for r in csr.orderBy("row").collect()] == [(10, 0, 3), (20, 3, 5), (30, 5, 5), (40, 5, 6)]
    assert [r["row"] for r in g.csr_to_coo(csr).orderBy("pos").collect()] == [10, 10, 10, 20, 20, 40]


def test_checks(edges, users, items, spark):
    assert schema.violations(edges, users, items).agg(F.sum("n")).first()[0] == 0
    rows = spark.createDataFrame([*ROWS, (99, 7, None)], "src long, dst long, value double")
    assert {r["rule"]: r["n"] for r in schema.violations(rows, users, items).collect()} == {"unknown_src": 1, "unknown_dst": 1, "nulls": 1, "repeated": 1}
    assert g.is_submatrix(edges.where("value > 2"), edges).first()["is_submatrix"]
    assert not g.is_submatrix(edges.withColumn("value", F.col("value") + 1), edges).first()["is_submatrix"]
    assert g.mismatches(edges, g.transpose(edges)).first()[0] == 0
    assert not g.contiguous(users).first()["contiguous"] and g.contiguous(spark.range(3)).first()["contiguous"] and g.contiguous(spark.range(0)).first()["contiguous"]


def test_unique_and_merge(spark, users):
    values = spark.createDataFrame([(0, 7), (1, 5), (2, 7), (3, 9)], "ord int, x int")
    assert [(r["value"], r["place"]) for r in g.unique_inverse(values, "ord", "x").orderBy("ord").collect()] == [(7, 0), (5, 1), (7, 0), (9, 2)]
    merged = g.merge_nodes({"a": users, "b": spark.createDataFrame([(20,), (15,)], "id long")})
    assert {(r["source"], r["id"]): r["place"] for r in merged.collect()}["b", 20] == 2
    found = g.id_to_index(spark.createDataFrame([(0, 30), (1, 31)], "ord int, id long"), users)
    assert {r["id"]: r["ind"] for r in found.collect()} == {30: 2, 31: -1}


def test_multi_link_split_keeps_empty_rows(edges, users, spark):
    types = g.link_types(edges)
    counts = g.link_degrees(edges, users, types)
    assert counts.count() == 20 and counts.agg(F.sum("n")).first()[0] == 6 and g.outside_domain(edges, types).isEmpty()
    same = edges.withColumn("value", F.lit(1.0))
    assert sorted(map(tuple, g.multi_link_split(same, g.link_types(same)).collect())) == [(0, 10, 0, 1), (0, 10, 1, 2), (0, 10, 2, 4), (0, 20, 0, 1), (0, 20, 1, 4), (0, 40, 0, 2)]
    assert not g.outside_domain(edges, types.where("value < 5")).isEmpty()


def test_segments(data, four):
    take = lambda how: [r["value"] for r in seg.reduce(data, four, how).orderBy("seg").collect()]
    assert take("sum") == [3, 0, 12, 13] and take("avg") == [1.5, 0, 4, 6.5] and take("min") == [1, None, 3, 6] and take("max") == [2, None, 5, 7]
    soft = [round(r["value"], 6) for r in seg.softmax(data).orderBy("pos").collect()]
    assert soft == [0.268941, 0.731059, 0.090031, 0.244728, 0.665241, 0.268941, 0.731059]
    right = four.withColumn("value", F.col("seg") * 10.0)
    for op, first in (("add", 23.0), ("sub", -17.0), ("mul", 60.0), ("div", 0.15), ("to", 20.0)):
        assert as_map(seg.broadcast(data, right, op), "pos")[2]["value"] == pytest.approx(first)


def test_broadcast_divides_by_zero(spark):
    data = spark.createDataFrame([(1, 0, 5.0), (1, 1, -5.0), (1, 2, 0.0), (2, 3, 5.0), (3, 4, None), (3, 5, 6.0), (4, 6, 5.0)], "seg long, pos long, value double")
    right = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 4.0), (4, None)], "seg long, value double")
    found = as_map(seg.broadcast(data, right, "div"), "pos")
    assert [found[k]["value"] for k in (0, 1, 3, 4, 5, 6)] == [math.inf, -math.inf, -math.inf, None, 1.5, None] and math.isnan(found[2]["value"])
    whole = seg.broadcast(data.withColumn("value", F.lit(3)), right.withColumn("value", F.lit(0)), "div")
    assert {r["value"] for r in whole.collect()} == {math.inf}


def test_rounded_as_sql_rounds(spark):
    odd = [41 / 640.0, -41 / 640.0, 2.5e-6, 0.49999999999999994e-6, -0.0, 1e305, math.inf, -math.inf, math.nan, None, 9007199254740993.0, 0.1 + 0.2]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, x double").select("i", "x", scalars.rounded(F.col("x"), 6).alias("value"))
    for r in rows.collect():
        assert repr(r["value"]) == repr(duckdb.execute("select round(?::double, 6) + 0.0", [r["x"]]).fetchone()[0]), r


def test_softmax_gradient_by_differences(data):
    weight = lambda df: sum(r["value"] * (r["pos"] + 1) ** 0.5 for r in df.collect())
    grad = data.select("seg", "pos", F.sqrt(F.col("pos") + 1).alias("value"))
    exact = as_map(seg.softmax_grad(seg.softmax(data), grad), "pos")
    step = 1e-4
    moved = lambda d: weight(seg.softmax(data.withColumn("value", F.col("value") + F.when(F.col("pos") == 3, d).otherwise(0.0))))
    assert exact[3]["value"] == pytest.approx((moved(step) - moved(-step)) / (2 * step), abs=1e-6)


def test_pools(edges, users, item_vectors):
    joined = g.with_support(edges).select(F.col("src").alias("seg"), F.col("dst").alias("pos"), F.col("dst").alias("id"), "support")
    segments = users.withColumnRenamed("id", "seg")

    def pool(how, weight=None):
        rows = seg.pool(joined, item_vectors, segments, how, 2, weight).collect()
        return {k: [round(next(r["value"] for r in rows if (r["seg"], r["i"]) == (k, i)), 4) for i in (0, 1)] for k in (10, 20, 30, 40)}

    assert pool("sum", "support") == {10: [0, 1.2247], 20: [0, 0.5], 30: [0, 0], 40: [0, 1.4142]}
    assert pool("sum") == {10: [0, 3], 20: [0, 1], 30: [0, 0], 40: [0, 2]}
    assert pool("avg") == {10: [0, 1], 20: [0, 0.5], 30: [0, 0], 40: [0, 2]}
    assert pool("max") == {10: [1, 2], 20: [1, 1], 30: [0, 0], 40: [0, 2]}


def test_max_pool_takes_the_first_on_ties(spark):
    tied = spark.createDataFrame([(0, 3, 1), (0, 5, 2)], "seg long, pos long, id long")
    same = spark.createDataFrame([(1, [2.0]), (2, [2.0])], "id long, vector array<float>")
    winners = seg.max_pool_winner(tied, same, 1)
    assert winners.first()["pos"] == 3
    grads = spark.createDataFrame([(0, [7.0])], "seg long, vector array<float>")
    assert [(r["id"], r["value"]) for r in seg.max_pool_grad(tied, winners, grads).collect()] == [(1, 7.0)]


def test_edge_vectors(edges, spark, item_vectors):
    left = spark.createDataFrame([(10, [1.0, 1.0]), (20, [2.0, 0.0]), (40, [0.0, 3.0])], "id long, vector array<float>")
    inner, apart = (as_map(f(edges, left, item_vectors), "src", "dst") for f in (seg.inner_product, seg.squared_distance))
    assert [inner[k]["value"] for k in ((10, 1), (10, 2), (10, 4), (20, 4), (40, 2))] == [1, 2, 0, -2, 6]
    assert [apart[k]["value"] for k in ((10, 1), (10, 2), (10, 4), (20, 4), (40, 2))] == [1, 2, 4, 10, 1]


def test_pool_gradient_is_the_transposed_pool(edges, users, spark, item_vectors):
    joined = g.with_support(edges).select(F.col("src").alias("seg"), F.col("dst").alias("id"), "support")
    grads = users.select(F.col("id").alias("seg"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    for average, weight in ((False, None), (True, None), (False, "support")):
        back = seg.pool_grad(joined, grads, item_vectors.select(F.col("id").alias("seg")), 2, average, weight)
        forth = seg.pool(joined, item_vectors, users.withColumnRenamed("id", "seg"), "avg" if average else "sum", 2, weight)
        x = {(r["id"], i): r["vector"][i] for r in item_vectors.collect() for i in (0, 1)}
        y = {(r["seg"], i): r["vector"][i] for r in grads.collect() for i in (0, 1)}
        assert sum(r["value"] * x[r["seg"], r["i"]] for r in back.collect()) == pytest.approx(sum(r["value"] * y[r["seg"], r["i"]] for r in forth.collect()))


def test_samples_and_negatives(edges, users, spark):
    sample = s.sample_neighbors(edges, 2, 5)
    assert sample.count() == 5 and sample.join(edges, ["src", "dst"], "left_anti").isEmpty()
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, s.sample_neighbors(edges, 2, 5).collect()))
    assert s.sample_neighbors(edges, -1).count() == 6
    targets = g.degrees(edges, users).where("degree > 0")
    none = s.negatives(edges, targets, 5, F.col("degree") * 10.0, 1)
    assert none.count() == 5 + 5 + 5 - 6 and none.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("other")), ["id", "other"], "left_semi").isEmpty()
    assert none.distinct().count() == none.count()
    walk = s.random_walks(edges, spark.createDataFrame([(0, 10), (1, 30)], "walk long, node long"), 3, 2)
    assert {r["walk"]: r["n"] for r in walk.groupBy("walk").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 1}


def test_splits_partition_the_edges(edges, users):
    split = splits.transductive(edges, 0.2, 0.5, 3)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 2, "valid": 2, "train": 2}
    held = splits.inductive_nodes(g.degrees(edges, users), 50, 1, least=0)
    assert held.where("held").count() == 2 and not held.where("degree = 0 and held").count()
    assert splits.batches(edges, 4).agg(F.max("batch")).first()[0] == 1 and splits.batches(edges, -1).agg(F.max("batch")).first()[0] == 0
    mask = splits.reconstruction_mask(users, 0.5, 1.0, 4)
    assert mask.where("chosen").count() == 2 and mask.where("mapped is null").count() == 2


def test_titles_genres_activations(spark):
    rows = spark.createDataFrame([("Toy Story (1995)",), ("unknown",)], "t string").select(scalars.title_text(F.col("t")), scalars.title_year(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("Toy Story ", 1995), ("unknown", 1950)]
    genres = ["Children", "unknown"]
    df = spark.createDataFrame([("Children's|Odd",)], "x string")
    assert df.select(scalars.genre_flags(F.col("x"), genres)).first()[0] == [1, 1] and df.select(scalars.genre_flags(F.col("x"), genres[:1])).first()[0] == [1]
    x = spark.createDataFrame([(-1.0,)], "x double")
    assert x.select(scalars.activation("elu", F.col("x"))).first()[0] == pytest.approx(math.exp(-1) - 1)
    with pytest.raises(ValueError):
        scalars.activation("odd", F.col("x"))


def test_rmse(spark):
    rows = spark.createDataFrame([(6.0, 5.0), (0.0, 1.0), (3.0, 2.0)], "prediction double, truth double")
    assert evaluate.rmse(rows, 1.0, 5.0).first()[0] == pytest.approx(0.57735, abs=1e-5) and evaluate.rmse(rows).first()[0] == 1.0


def test_hetero_graph(edges, users, items, spark, tmp_path):
    graph = HeteroGraph({"user": users, "item": items}, {("user", "item"): edges})
    less = graph.remove_edges(("item", "user"), spark.createDataFrame([(4, 10)], "src long, dst long"))
    assert less["user", "item"].count() == 5 == less["item", "user"].count() and graph["user", "item"].count() == 6
    assert graph.select("item", items.where("id = 2"))["user", "item"].count() == 2
    graph.save(str(tmp_path / "g"))
    again = HeteroGraph.load(spark, str(tmp_path / "g"))
    assert again.types() == ["item", "user"] and again.relations_of("item") == [("item", "user")]
    assert sorted(map(tuple, again["user", "item"].collect())) == sorted(map(tuple, edges.collect()))
    own = HeteroGraph({"user": users}, {("user", "user"): spark.createDataFrame([(10, 20, 1.0), (20, 10, 1.0)], "src long, dst long, value double")})
    assert own.remove_edges(("user", "user"), spark.createDataFrame([(10, 20)], "src long, dst long"))["user", "user"].count() == 0
    with pytest.raises(ValueError):
        HeteroGraph({"user": users, "item": items}, {("user", "item"): edges, ("item", "user"): edges})


def test_files(spark, tmp_path, edges):
    (tmp_path / "r.dat").write_text("1::7::4::978300760\n2::7::5::978302109\n")
    (tmp_path / "m.dat").write_text("7::Toy Story (1995)::Animation|Children's\n")
    rated = files.read_ratings(spark, str(tmp_path / "r.dat"), "ml-1m")
    assert rated.agg(F.sum("rating")).first()[0] == 9.0 and files.read_users(spark, None, "ml-10m", rated).count() == 2
    assert files.read_items(spark, str(tmp_path / "m.dat"), ["Children", "Drama"], "ml-1m").first()["flags"] == [1, 0]
    with pytest.raises(ValueError):
        files.read_ratings(spark, "x", "other")
    storage.write_edges_text(edges, str(tmp_path / "edges"))
    assert sorted(map(tuple, storage.read_edges_text(spark, str(tmp_path / "edges")).collect())) == sorted(map(tuple, edges.collect()))
    metrics = str(tmp_path / "metrics")
    storage.append_metrics(spark, metrics, [{"rmse": 1.5}, {"rmse": 1.25, "loss": 2.0}])
    storage.append_metrics(spark, metrics, [{"rmse": 1.0}])
    assert sorted(tuple(r) for r in storage.read_metrics(spark, metrics).collect()) == [(0, "rmse", 1.5), (1, "loss", 2.0), (1, "rmse", 1.25), (2, "rmse", 1.0)]


def test_negatives_of_nearly_full_graphs(spark):
    full = [(s, d) for s in range(10) for d in range(10)]
    edges = spark.createDataFrame([(s, d, 1) for s, d in full if (s, d) != (3, 7)], "src long, dst long, value int")
    made = s.negatives_same_node(edges, 10, 10).collect()
    assert len(made) == 99 and {(r["new_src"], r["new_dst"]) for r in made} == {(3, 7)}
    drawn = s.negatives_all(edges, 10, 10, 30).collect()
    assert len(drawn) == 30 and {(r["src"], r["dst"]) for r in drawn} == {(3, 7)}
    every = spark.createDataFrame([(s, d, 1) for s, d in full], "src long, dst long, value int")
    assert s.negatives_all(every, 10, 10, 5).count() == 0 and s.negatives_same_node(every, 10, 10).count() == 0



def test_config(tmp_path):
    assert config.load(train={"rate": 1})["train"]["rate"] == 1
    for wrong, error in (({"odd": 1}, KeyError), ({"train": {"steps": "many"}}, TypeError), ({"train": 3}, TypeError), ({"model": {"mask": {"zero": 0.5}}}, ValueError)):
        with pytest.raises(error):
            config.load(**wrong)
    assert [config.dump(config.DEFAULTS, str(tmp_path)).name for _ in range(2)] == ["config0.json", "config1.json"]


def test_networks(edges, users, items, item_vectors):
    linked = g.with_support(edges).withColumn("link_id", F.lit(0))
    plain = network.Aggregator([network.Dense([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])], act="identity")
    found = {r["id"]: [round(v, 4) for v in r["vector"]] for r in plain.apply(linked, item_vectors, users).collect()}
    assert found == {10: [0, 1.2247], 20: [0, 0.5], 30: [0, 0], 40: [0, 1.4142]}
    two = network.Aggregator([network.Dense([[1.0, 0.0]]), network.Dense([[0.0, 1.0]])], ordinal=True)
    assert two.map_of(1).weight == [[1.0, 1.0]]
    plan = network.khop_plan({"user": edges, "item": g.transpose(edges)}, {"user": users.where("id = 40")}, {"user": "item", "item": "user"}, 2, -1)
    assert plan[0]["user"].edges.count() == 1 and {r["id"] for r in plan[1]["item"].ids.collect()} == {2}
    with pytest.raises(ValueError):
        network.Aggregator([], combine="mean")


def _exchanges(df, spark):
    """Exchanges that the plan writes, one that is reused counted once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]


@pytest.fixture
def stored(spark, tmp_path):
    """Tables on disk, whose joins aren't broadcast: rows, nodes, vectors of 3 components."""
    spark.createDataFrame([(s, d, v + 1.0) for s in range(4) for d in range(6) for v in range(3) if (s + d + v) % 2], "src long, dst long, value double").write.parquet(f"{tmp_path}/rows")
    spark.range(5).write.parquet(f"{tmp_path}/nodes")
    vectors = [(d, [d + 0.5, None if d == 2 else -1.0 * d, float(d * d)]) for d in range(4)] + [(4, [None] * 3), (5, None)]
    spark.createDataFrame(vectors, "id long, vector array<float>").write.parquet(f"{tmp_path}/vectors")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield [spark.read.parquet(f"{tmp_path}/{x}") for x in ("rows", "nodes", "vectors")]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_are_exchanged_once_for_a_layer(stored, spark):
    rows, nodes, vectors = stored
    edges = g.build_graph(rows, "max")
    # Pairs, both degrees, edges by either end.
    assert len(_exchanges(g.with_support(edges), spark)) == 5
    linked = g.with_support(edges).withColumn("link_id", (F.col("value") - 1).cast("int"))
    # Nodes besides: the pool moves no edges and no vectors.
    aggregator = network.Aggregator([network.Dense([[1.0, 2.0, 3.0]])] * 3, "stack")
    assert len(_exchanges(aggregator.apply(linked, vectors, nodes), spark)) == 6


@pytest.mark.parametrize(("combine", "units"), [("sum", 2), ("stack", 2), ("sum", 4), ("stack", 4)])
def test_aggregator_by_hand(stored, combine, units, monkeypatch):
    rows, nodes, vectors = stored
    edges = g.build_graph(rows, "max").withColumn("link_id", (F.col("value") - 1).cast("int")).withColumn("support", 1 / (1 + F.col("dst")))
    dense = [network.Dense([[o - i + k * 0.5 for i in range(3)] for o in range(units)], [o + k + 0.25 for o in range(units)]) for k in range(2)]
    given = {r["id"]: r["vector"] for r in vectors.collect()}
    want = {}
    for node in range(5):
        parts = [[0.0] * units for _ in dense]
        for k, m in enumerate(dense):
            own = [(given[r["dst"]] or [], r["support"]) for r in edges.where(f"src = {node} and link_id = {k}").collect()]
            if any(c is not None for v, _ in own for c in v):
                parts[k] = [sum(w * (sum((c or 0) * m.weight[o][i] for i, c in enumerate(v)) + m.bias[o]) for v, w in own) for o in range(units)]
        want[node] = sum(parts, []) if combine == "stack" else [sum(x) for x in zip(*parts, strict=True)]
    for most in (network._SENT, 0):
        monkeypatch.setattr(network, "_SENT", most)
        found = {r["id"]: r["vector"] for r in network.Aggregator(dense, combine, "identity").apply(edges, vectors, nodes).collect()}
        assert found == {k: pytest.approx(v) for k, v in want.items()}


def test_layer_adds_its_own_map(stored, spark):
    rows, nodes, vectors = stored
    edges = g.build_graph(rows, "max").withColumn("link_id", F.lit(0)).withColumn("support", F.lit(0.0))
    item = network.Aggregator([network.Dense([[1.0, 0.0, 0.0]])], act="identity")
    own = network.Dense([[1.0, 1.0, 1.0]], [0.5])
    layer = network.Layer({"item": item}, network.Dense([[2.0]]), own=own, act="identity")
    # Nodes 2 to 4 have no vector of their own.
    itself = vectors.where("id < 2").select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    applied = layer.apply({"item": edges}, {"item": vectors}, nodes, itself)
    assert {r["id"]: r["vector"] for r in applied.collect()} == {0: [2.0], 1: [4.0], 2: [0.0], 3: [0.0], 4: [0.0]}


def test_training_lowers_the_error(spark):
    rows = spark.range(200).select(F.array(F.lit(1.0), (F.col("id") % 7) / 7.0).alias("a"), F.array((F.col("id") % 5) / 5.0, F.lit(1.0)).alias("b"))
    rows = rows.withColumn("truth", F.get("a", F.lit(1)) * F.get("b", F.lit(0)) * 2 - 0.5)
    _, scores = training.fit_bilinear(rows, 2, steps=8, rate=0.2)
    assert scores[-1] < 0.7 * scores[0]


def test_live_degrees(spark, tmp_path, edges):
    edges.select("src", "dst").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live_degrees(spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in")))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("live").start()
    running.processAllAvailable()
    running.stop()
    assert {r["id"]: r["degree"] for r in spark.table("live").collect()} == {10: 3, 20: 2, 40: 1}


def test_segment_ids_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(seg, "BLOCK", 3)
    starts = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 9)], "seg long, start long")
    found = seg.segment_ids(starts, spark.range(11).withColumnRenamed("id", "pos"))
    assert [r["seg"] for r in found.orderBy("pos").collect()] == [0, 0, 2, 2, 2, 2, 2, 2, 2, 3, 3]


def test_running_sums_over_many_parts(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000 - 10_000).alias("x"), F.lit(2).alias("n"))
    found = g.running(rows, "x", F.col("n"), "had")
    assert found.where(F.col("had") != 2 * (F.col("x") + 10_000)).isEmpty() and found.count() == 20_000
    assert g.running(rows.limit(0), "x").isEmpty()
    names = spark.createDataFrame([(c,) for c in "dbca"], "x string")
    assert [r["x"] for r in g.running(names, "x").orderBy("ind").collect()] == list("abcd")


def test_set_graph_grows_until_a_cap(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2)], "a long, b long")
    more = spark.createDataFrame([(0, 2, 1), (1, 3, 3), (2, 3, 1), (3, 1, 3), (4, 4, 2), (5, 5, 4)], "ord long, src long, dst long")
    both = lambda **caps: [sorted(tuple(r) for r in df.collect()) for df in g.grown(nodes, edges, more, **caps)]
    assert both() == [[(1,), (2,), (3,), (4,), (5,)], [(1, 2), (1, 3), (2, 4), (4, 5)]]
    assert both(max_nodes=4) == [[(1,), (2,), (3,), (4,)], [(1, 2), (1, 3), (2, 4)]]
    assert both(max_edges=2) == [[(1,), (2,), (3,)], [(1, 2), (1, 3)]]


def test_short_numbers_are_those_of_c(spark):
    values = [0.0, 1.0, -2.5, 1e-7, 0.0001, 0.00012345678, 123456.0, 1234567.0, 999999.5, 3.14159265, 1e20]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", storage.short_number(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["%g" % r["x"] for r in rows]
