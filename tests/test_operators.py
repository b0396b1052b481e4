"""Small cases with known answers, and brute force on random input."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import finance as fin, scalars
from tessera.operators import graph, joins, temporal, triples, windows
from tessera.session import cut


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- joins --------------------------------------------------------------------------------------

def test_asof_backward_forward_and_tolerance(spark):
    trades = _df(spark, [(10, 1.0), (30, 2.0), (50, 3.0)], "timestamp long, trade_price double")
    quotes = _df(spark, [(5, 99.0), (20, 100.0), (40, 101.0), (60, 103.0)], "timestamp long, quote_price double")
    out = joins.asof_join(trades, quotes, "timestamp", tolerance=100, prefix="q_").orderBy("timestamp").collect()
    assert [r.q_quote_price for r in out] == [99.0, 100.0, 101.0]
    acks = _df(spark, [(15, "ack"), (35, "done"), (55, "late")], "timestamp long, status string")
    out = joins.asof_join(trades, acks, "timestamp", tolerance=20, direction="forward", prefix="q_").orderBy("timestamp").collect()
    assert [r.q_status for r in out] == ["ack", "done", "late"]
    one, far = _df(spark, [(100, 1)], "t long, v int"), _df(spark, [(50, 99.0)], "t long, bid double")
    assert [joins.asof_join(one, far, "t", tolerance=tol, prefix="r_").first().r_bid for tol in (10, 100)] == [None, 99.0]
    assert joins.asof_join(trades, quotes.where("false"), "timestamp", prefix="q_").count() == 3


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("bucket", [None, 10.0])
def test_asof_equals_nested_loop(spark, direction, bucket):
    rng = np.random.default_rng(7)
    left = [(int(i), int(rng.integers(0, 4)), int(rng.integers(0, 60))) for i in range(120)]
    right = [(int(i), int(rng.integers(0, 4)), int(rng.integers(0, 60))) for i in range(80)]
    out = joins.asof_join(_df(spark, left, "id long, k int, t long"), _df(spark, right, "rid long, k int, t long"), "t", ["k"], direction=direction, tie="rid", bucket=bucket, tolerance=9, prefix="r_")
    got = {r.id: r.r_rid for r in out.collect()}
    for i, k, t in left:
        if direction == "backward":
            hits = [(t2, -r) for r, k2, t2 in right if k2 == k and t - 9 <= t2 <= t]
        else:
            hits = [(-t2, r) for r, k2, t2 in right if k2 == k and t <= t2 <= t + 9]
        want = abs(max(hits)[1]) if hits else None
        assert got[i] == want


def test_interval_range_and_positional_joins(spark):
    a = _df(spark, [(i, i % 3, i * 7 % 50) for i in range(60)], "id long, k long, t long")
    b = _df(spark, [(i, i % 3, i * 11 % 50) for i in range(60)], "id long, k long, t long")
    got = {(r.left_id, r.right_id) for r in joins.interval_join(a, b, "t", ["k"], 4).collect()}
    assert got == {(x.id, y.id) for x in a.collect() for y in b.collect() if x.k == y.k and abs(x.t - y.t) <= 4}
    r = _df(spark, [(1, 3.0, 9.0), (2, 9.5, 8.0), (3, -25.0, 100.0)], "rid long, lo double, hi double")
    got = {(x.id, x.rid) for x in joins.range_join(a, r, "t", "lo", "hi", 10.0).collect()}
    assert got == {(x.id, y) for x in a.collect() for y, lo, hi in ((1, 3, 9), (3, -25, 100)) if lo <= x.t <= hi}
    pos = joins.positional_join(a.select("id"), b.where("id < 50").select(F.col("id").alias("other")), ["id"], [F.col("other").desc()])
    assert {(r.id, r.other) for r in pos.collect()} == {(i, 49 - i if i < 50 else None) for i in range(60)}


# ---- windows ------------------------------------------------------------------------------------

def test_tumbling_counts_and_fill(spark):
    at = datetime(2024, 1, 1)
    rows = [("user1", at, 10.0), ("user1", at + timedelta(seconds=5), 20.0), ("user2", at + timedelta(seconds=2), 15.0), ("user2", at + timedelta(seconds=15), 25.0)]
    df = _df(spark, rows, "user_id string, ts timestamp, amount double")
    out = windows.window_aggregate(df, "ts", "10 seconds", {"total": F.sum("amount"), "n": F.count("*")}, ["user_id"]).collect()
    assert sorted((r.user_id, r.window_start.second, r.total, r.n) for r in out) == [("user1", 0, 30.0, 2), ("user2", 0, 15.0, 1), ("user2", 10, 25.0, 1)]
    gap = _df(spark, [("a", at, 1.0), ("a", at + timedelta(seconds=40), 5.0)], "k string, ts timestamp, v double")
    filled = windows.sample_by(gap, "ts", "10 seconds", {"v": F.avg("v")}, ["k"], "linear").orderBy("ts").collect()
    assert [r.v for r in filled] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert windows.latest_by(df, ["user_id"], ["ts"]).where("user_id = 'user2'").first().amount == 25.0


# ---- graphs -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tree(spark):
    return _df(spark, [(0, 1), (0, 2), (1, 3), (1, 4)], "src long, dst long")


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_bfs_and_hops(spark, tree):
    zero = _df(spark, [(0,)], "id long")
    assert _ids(graph.bfs(tree, zero)) == [0, 1, 2, 3, 4] and _ids(graph.bfs(tree, zero, 1)) == [0, 1, 2]
    assert [_ids(graph.k_hop(tree, zero, k)) for k in (0, 1, 2)] == [[0], [1, 2], [3, 4]]
    assert _ids(graph.bfs(tree, _df(spark, [(0,), (5,)], "id long"))) == [0, 1, 2, 3, 4, 5]


def test_shortest_paths(spark):
    e = _df(spark, [(0, 1, 5), (0, 2, 2), (1, 3, 3), (1, 4, 1), (2, 4, 2), (4, 3, 1), (4, 5, 4)], "src long, dst long, w int")
    out = {r.id: (r.dist, r.parent) for r in graph.shortest_paths(e, _df(spark, [(0,)], "id long"), "w").collect()}
    assert {k: v[0] for k, v in out.items()} == {0: 0, 1: 5, 2: 2, 3: 5, 4: 4, 5: 8} and [out[k][1] for k in (3, 4, 2)] == [4, 2, 0]
    with pytest.raises(ValueError):
        graph.shortest_paths(_df(spark, [(0, 1, -1)], "src long, dst long, w int"), _df(spark, [(0,)], "id long"), "w")


def test_components_cycles_and_closure(spark, tree):
    two = _df(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)], "src long, dst long")
    assert sorted(r["size"] for r in graph.component_sizes(graph.connected_components(two)).collect()) == [3, 3]
    assert {r.component for r in graph.strong_components(two).collect()} == {0, 3}
    assert len({r.component for r in graph.strong_components(tree).collect()}) == 5
    assert graph.has_cycle(two) and not graph.has_cycle(tree)
    assert {r.id: r.level for r in graph.topological_levels(tree).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    cycle, zero = _df(spark, [(0, 1), (1, 2), (2, 0)], "src long, dst long"), _df(spark, [(0,)], "id long")
    assert sorted(r.finish for r in graph.closure(cycle, zero).collect()) == [1, 2]
    assert sorted(r.finish for r in graph.closure(cycle, zero, keep_start=True).collect()) == [0, 1, 2]
    chain = _df(spark, [(0, 1), (1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert graph.variable_paths(chain, zero, 2, 3).count() == 2
    assert [tuple(r) for r in graph.match_path(_df(spark, [(0, 1), (1, 2), (2, 3)], "src long, dst long"), "abc").orderBy("a").collect()] == [(0, 1, 2), (1, 2, 3)]


def test_pagerank_triangles_betweenness(spark):
    e = _df(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    rank = {r.id: r["rank"] for r in graph.pagerank(e, max_iter=60).collect()}
    want = np.full(4, 0.25)
    m = np.zeros((4, 4))
    for s, d, p in ((0, 1, 1), (1, 2, 1), (2, 0, 0.5), (2, 3, 0.5)):
        m[d, s] = p
    m[:, 3] = 0.25
    for _ in range(60):
        want = 0.15 / 4 + 0.85 * m @ want
    assert [rank[i] for i in range(4)] == pytest.approx(list(want), abs=1e-5)
    assert [tuple(r) for r in graph.triangles(e).collect()] == [(0, 1, 2)]
    coefficient = {r.id: r.coefficient for r in graph.clustering(e).collect()}
    assert coefficient[0] == 1.0 and coefficient[2] == pytest.approx(1 / 3)
    path = _df(spark, [(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert {r.id: r.score for r in graph.betweenness(path, graph.vertices(path)).collect()} == {0: 0, 1: 2, 2: 2, 3: 0}


@pytest.mark.parametrize("name", ["graph_a_star", "graph_pagerank", "graph_bfs", "graph_multi_source_bfs", "graph_all_pairs", "graph_shortest_paths", "graph_strong_components", "graph_weighted_betweenness", "graph_betweenness", "graph_edge_betweenness"])
def test_graph_loops_send_no_table_through_the_driver(spark, monkeypatch, name):
    """Tables of this size would be broadcast, as the estimates of larger ones are too low."""
    from tessera.plans import registry

    plans, cut = [], graph.cut

    def noted(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graph, "cut", noted)
    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_text_functions_hold_slices_of_a_batch(spark):
    import pyarrow as pa

    held = []
    run = scalars._of_texts(lambda t: held.append(1) or len(t), pa.int64())
    assert run(pa.array(["é" * 400_000, None, "ab"] * 4)).to_pylist() == [400_000, None, 2] * 4 and len(held) == 8
    row = _df(spark, [("e\u0301a\r\nb",), (None,)], "t string").select(scalars.strip_accents("t"), scalars.nfc_normalize("t"), scalars.grapheme_length("t")).collect()
    assert [tuple(r) for r in row] == [("ea\r\nb", "éa\r\nb", 4), (None, None, None)]


def test_range_join_deals_out_a_bin_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "RANGE_PAIRS", 1000)
    points, ranges = spark.range(400).select("id", (F.col("id") % 10).alias("v")), spark.range(50).select(F.col("id").alias("r"), F.lit(3).alias("lo"), F.lit(5).alias("hi"))
    out = joins.range_join(points, ranges, "v", "lo", "hi", 10.0)
    tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 120 * 50 and out.distinct().count() == 120 * 50
    assert len(tasks) > 4


def test_triangles_make_no_rows_of_wedges(spark):
    e = _df(spark, [(0, k) for k in range(1, 8)] + [(1, 2), (2, 3)], "src long, dst long")
    out = graph.triangles(e)
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 2), (0, 2, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


# ---- triples ------------------------------------------------------------------------------------

def test_triples(spark, tmp_path):
    lines = ['<a> <knows> <b> .', '<b> <knows> <c> .', '<c> <knows> <a> .', '<a> <name> "Ann \\"A\\""@en .', '<b> <age> "41"^^<http://www.w3.org/2001/XMLSchema#int> .', "# note", ""]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    t = triples.read_ntriples(spark, str(tmp_path / "x.nt")).cache()
    assert t.count() == 5
    two = triples.basic_pattern(t, [("?x", "<knows>", "?y"), ("?y", "<knows>", "?z")])
    assert two.count() == 3 and triples.match(t, "?x", "<knows>", "?x").count() == 0
    knows = triples.step(t, "<knows>")
    only = spark.createDataFrame([("<a>",)], "id string")
    assert sorted(r.dst for r in triples.one_or_more(knows, only).collect()) == ["<a>", "<b>", "<c>"]
    assert sorted(r.dst for r in triples.zero_or_more(knows, only).collect()) == ["<a>", "<b>", "<c>"]
    assert triples.sequence(knows, triples.inverse(knows)).count() == 3
    o = F.col("o")
    terms = t.select("p", triples.lexical(o).alias("l"), triples.lang(o).alias("g"), triples.datatype(o).alias("d"), triples.number(o).alias("n")).collect()
    by = {r.p: r for r in terms}
    assert by["<name>"].g == "en" and by["<age>"].n == 41.0 and by["<age>"].d.endswith("int")
    with pytest.raises(Exception):
        (tmp_path / "bad.nt").write_text("not a triple")
        triples.read_ntriples(spark, str(tmp_path / "bad.nt")).collect()


# ---- finance ------------------------------------------------------------------------------------

def test_series(spark):
    ax = fin.Axis(["s"], ["t"])
    df = _df(spark, [("a", i, p) for i, p in enumerate((100.0, 102.0, 101.0, 103.0, 102.5))], "s string, t int, price double")
    out = df.withColumn("r", fin.log_returns(F.col("price"), ax)).orderBy("t").collect()
    assert out[0].r == 0.0 and out[1].r == pytest.approx(math.log(1.02))
    v = _df(spark, [("a", 0, 100.0, 1000.0), ("a", 1, 101.0, 2000.0)], "s string, t int, price double, volume double")
    assert v.withColumn("v", fin.vwap(F.col("price"), F.col("volume"), ax)).orderBy("t").collect()[1].v == pytest.approx(100.6667, abs=1e-4)
    apr = _df(spark, [(1e-4,)], "f double").select(fin.funding_apr(F.col("f")).alias("x")).first().x
    assert apr == pytest.approx(0.1095)


@pytest.mark.parametrize("step, inputs, outputs", [(fin.ewma_step(0.5), ["x"], ["v"]), (fin.macd_step(), ["x"], ["m", "s", "h"]), (fin.rsi_step(), ["x"], ["v"]),
                                                   (fin.kalman_step(0.01, 1.0), ["x"], ["v"]), (fin.vpin_step(50.0), ["x", "y"], ["v"]), (fin.hedge_ratio_step(), ["x", "y"], ["b", "s"]), (fin.ewcov_step(0.1), ["x", "y"], ["c"])])
def test_recursive_filters_keep_state_between_batches(spark, step, inputs, outputs):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(a), float(b)) for k in "ab" for i, (a, b) in enumerate(rng.uniform(1, 9, (500, 2)))]
    df = _df(spark, rows, "k string, i int, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = fin.recurrent(df, ["k"], ["i"], inputs, outputs, step).orderBy("k", "i").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    at = {"x": 2, "y": 3}
    for k in "ab":
        want = step(np.array([[r[at[c]] for c in inputs] for r in rows if r[0] == k]), {})
        assert np.allclose([[r[o] for o in outputs] for r in got if r.k == k], want)


# ---- scalars, temporal, sources -----------------------------------------------------------------

def test_business_days(spark):
    rng = np.random.default_rng(3)
    starts = np.datetime64("2024-01-01") + rng.integers(0, 400, 200)
    ends = np.datetime64("2024-01-01") + rng.integers(0, 400, 200)
    off = ["2024-01-01", "2024-07-04", "2024-12-25", "2024-12-28"]
    rows = [(str(a), str(b), int(n)) for a, b, n in zip(starts, ends, rng.integers(-8, 9, 200))]
    df = _df(spark, rows, "a string, b string, n int").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"), "n")
    out = df.select("*", scalars.business_days_between(F.col("a"), F.col("b"), off).alias("between"), scalars.add_business_days(F.col("a"), F.col("n"), off).alias("moved")).collect()
    for r in out:
        want = np.busday_count(min(r.a, r.b), max(r.a, r.b), holidays=off)
        assert r.between == (want if r.a <= r.b else -want)
        assert np.datetime64(r.moved) == np.busday_offset(r.a, r.n, roll="forward", holidays=off)


def test_temporal_changes(spark):
    df = temporal.close_versions(_df(spark, [(1, 10, "a"), (1, 20, "b"), (2, 15, "c")], "k long, sys_from long, v string"), ["k"])
    assert {r.v for r in temporal.as_of(df, 17).collect()} == {"a", "c"}
    changed = temporal.apply_changes(df, _df(spark, [(2, "d")], "k long, v string"), ["k"], 30)
    assert {r.v for r in temporal.as_of(changed, 40).collect()} == {"b", "d"} and {r.v for r in temporal.as_of(changed, 29).collect()} == {"b", "c"}
    assert [r.v for r in temporal.history(changed, k=2).collect()] == ["c", "d"]


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\nbad,y\n3,z\n")
    good, bad = sources.read_csv_with_rejects(spark, str(tmp_path / "x.csv"), "a int, b string")
    assert sorted(r.a for r in good.collect()) == [1, 3] and [r.line for r in bad.collect()] == ["bad,y"]
    with pytest.raises(ValueError):
        sources.read(spark, "ftp://host/x")
    plan = sources.read(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], "l_quantity > 49")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "l_tax" not in plan


def test_cut_ends_lineage(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString() and df.agg(F.sum("x")).first()[0] == 90


# ---- all pairs, A*, betweenness -----------------------------------------------------------------

WEIGHTED = [(0, 1, 5.0), (0, 2, 2.0), (1, 3, 3.0), (1, 4, 1.0), (2, 4, 2.0), (4, 3, 1.0), (4, 5, 4.0)]


def test_all_pairs_and_a_star(spark):
    e = _df(spark, WEIGHTED, "src long, dst long, w double")
    pairs = {(r.start, r.finish): r.dist for r in graph.all_pairs(e, weight="w").collect()}
    assert [pairs[0, i] for i in range(6)] == [0, 5, 2, 5, 4, 8] and (3, 0) not in pairs
    for left in (F.lit(0.0), F.when(F.col("id") == 4, 4.0).when(F.col("id") == 5, 0.0).otherwise(4.5)):
        found = {r.id: r for r in graph.a_star(e, 0, 5, left, weight="w").collect()}
        assert found[5].dist == 8 and found[5].parent == 4 and found[4].parent == 2
    assert graph.a_star(e, 3, 0, F.lit(0.0), weight="w").where("id = 0").isEmpty()
    with pytest.raises(ValueError):
        graph.all_pairs(e.withColumn("w", -F.col("w")), weight="w")


def _paths(edges, s, t):
    """All simple paths by brute force."""
    out, stack = [], [(s, [s], 0.0)]
    while stack:
        at, path, cost = stack.pop()
        if at == t and len(path) > 1:
            out.append((cost, path))
            continue
        stack += [(b, [*path, b], cost + w) for a, b, w in edges if a == at and b not in path]
    least = min((c for c, _ in out), default=None)
    return [p for c, p in out if c == least]


@pytest.mark.parametrize("weight", [None, "w"])
def test_betweenness_equals_brute_force(spark, weight):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)): float(rng.integers(1, 4)) for a, b in rng.integers(0, 9, (26, 2)) if a != b}
    rows = [(a, b, w if weight else 1.0) for (a, b), w in edges.items()]
    vertex, edge = {v: 0.0 for ab in edges for v in ab}, dict.fromkeys(edges, 0.0)
    for s in vertex:
        for t in vertex:
            short = _paths(rows, s, t) if s != t else []
            for p in short:
                for v in p[1:-1]:
                    vertex[v] += 1 / len(short)
                for ab in zip(p, p[1:]):
                    edge[ab] += 1 / len(short)
    e = _df(spark, rows, "src long, dst long, w double")
    assert {r.id: pytest.approx(r.score) for r in graph.betweenness(e, weight=weight).collect()} == vertex
    assert {(r.src, r.dst): pytest.approx(r.score) for r in graph.edge_betweenness(e, weight=weight).collect()} == edge
    n = len(vertex)
    assert graph.betweenness(e, weight=weight, normalised=True).agg(F.max("score")).first()[0] == pytest.approx(max(vertex.values()) / ((n - 1) * (n - 2)))


def test_global_rank_equals_window(spark):
    rows = [(i, i * 7 % 13) for i in range(200)]
    out = joins.global_rank(_df(spark, rows, "id long, v long"), [F.col("v").desc()], "place").collect()
    assert {r.id: r.place for r in out} == {i: 1 + sum(w > v for _, w in rows) for i, v in rows}


# ---- more of triples ----------------------------------------------------------------------------

def test_turtle_and_quads(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('''@prefix ex: <http://e.org/> . # a comment
@base <http://b.org/> .
ex:a a ex:Person ; ex:name "Ann \\"A\\""@en , "x"^^ex:t ; ex:age 41 ; ex:height 1.7 ; ex:ok true .
<c> ex:knows [ ex:name """two
lines""" ], _:n .
''')
    got = {tuple(r) for r in triples.read_turtle(spark, str(tmp_path / "a.ttl")).collect()}
    e, xsd = "<http://e.org/{}>".format, "<http://www.w3.org/2001/XMLSchema#{}>".format
    fixed = {(e("a"), "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", e("Person")), (e("a"), e("name"), '"Ann \\"A\\""@en'), (e("a"), e("name"), f'"x"^^{e("t")}'),
             (e("a"), e("age"), f'"41"^^{xsd("integer")}'), (e("a"), e("height"), f'"1.7"^^{xsd("decimal")}'), (e("a"), e("ok"), f'"true"^^{xsd("boolean")}')}
    rest = got - fixed
    assert fixed <= got and len(rest) == 3 and {s for s, p, _ in rest if p == e("knows")} == {"<http://b.org/c>"}
    (blank,) = {o for _, p, o in rest if p == e("knows") and o.endswith("t1")}
    assert (blank, e("name"), '"two\\nlines"') in rest
    (tmp_path / "a.nq").write_text('<http://a> <http://p> "v" <http://g> .\n<http://a> <http://p> <http://b> .\n')
    assert sorted((r.o, r.g) for r in triples.read_nquads(spark, str(tmp_path / "a.nq")).collect()) == [('"v"', "<http://g>"), ("<http://b>", None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_unbound_variables_agree_with_every_value(spark, how):
    rng = np.random.default_rng(5)
    value = lambda: [None, "a", "b", "c"][rng.integers(0, 4)]
    a, b = [[("x", "y")[rng.integers(0, 2)], value(), value()] for _ in range(12)], [[("x", "z")[rng.integers(0, 2)], value(), value()] for _ in range(10)]
    left = _df(spark, [(*r, i) for i, r in enumerate(a)], "k string, u string, v string, i int")
    right = _df(spark, [(*r, j) for j, r in enumerate(b)], "k string, u string, v string, j int")
    want = []
    for i, (k, u, v) in enumerate(a):
        hits = [(k, u if u is not None else u2, v if v is not None else v2, i, j) for j, (k2, u2, v2) in enumerate(b)
                if k == k2 and (u is None or u2 is None or u == u2) and (v is None or v2 is None or v == v2)]
        want += hits or ([(k, u, v, i, None)] if how == "left" else [])
    out = triples.join_solutions(left, right, how, unbound=["u", "v"]).select("k", "u", "v", "i", "j").collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_linear_recurrence_equals_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        x, v, want = rng.normal(size=n), 0.5, []
        for a in x:
            v = 0.93 * v + a
            want.append(v)
        assert np.allclose(fin.linear(x, 0.93, 0.5), want, rtol=1e-12, atol=1e-12)
    assert fin.linear(np.ones(3), 0.0).tolist() == [1, 1, 1] and fin.linear(np.ones(3), 1.0).tolist() == [1, 2, 3]
