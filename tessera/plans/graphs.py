"""Graph, triple and temporal queries over graphs derived from the tables.

All grow with their tables. Parts graph: part p leads to parts 2p and 3p + 1, where those exist. Links graph: customers of each run of 100
keys lead to two others of the run. Friends graph: customers of one nation whose keys differ by at most 200.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, joins, temporal, triples
from tessera.plans.register import Group
from tessera.session import table

QUERIES = Group()
query = QUERIES.query

PARTS_SQL = ("edges AS (SELECT p_partkey AS src, 2 * p_partkey AS dst FROM part WHERE 2 * p_partkey IN (SELECT p_partkey FROM part) "
             "UNION SELECT p_partkey, 3 * p_partkey + 1 FROM part WHERE 3 * p_partkey + 1 IN (SELECT p_partkey FROM part))")
LINKS_SQL = ("edges AS (SELECT c_custkey AS src, c_custkey - c_custkey % 100 + (c_custkey * 7 + 3) % 100 AS dst FROM customer "
             "UNION SELECT c_custkey, c_custkey - c_custkey % 100 + (c_custkey % 100) // 2 FROM customer)")


def parts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"))
    led = p.select("src", F.explode(F.array(F.col("src") * 2, F.col("src") * 3 + 1)).alias("dst"))
    # Sorted: keys alone look small beside the file, and would go through the driver.
    return led.join(p.select(F.col("src").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")


def links(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    run, at = F.col("src") - F.col("src") % 100, F.col("src") % 100
    return c.select("src", F.explode(F.array(run + (F.col("src") * 7 + 3) % 100, run + F.floor(at / 2))).alias("dst")).distinct()


def one(spark, i=1):
    return spark.createDataFrame([(i,)], "id long")


_REACH = "r(id, dist) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, dist + 1 FROM r JOIN edges ON id = src WHERE dist < 30)"


@query("graph_bfs", f"WITH RECURSIVE {PARTS_SQL}, {_REACH} SELECT id, min(dist)::INT AS dist FROM r GROUP BY id")
def graph_bfs(spark, d):
    return graph.bfs(parts(spark, d), one(spark)).select("id", "dist")


@query("graph_k_hop", f"WITH RECURSIVE {PARTS_SQL}, {_REACH} SELECT id FROM r GROUP BY id HAVING min(dist) = 3")
def graph_k_hop(spark, d):
    return graph.k_hop(parts(spark, d), one(spark), 3)


@query("graph_components", f"""WITH RECURSIVE {LINKS_SQL}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
r(id, other) AS (SELECT src, src FROM b UNION SELECT r.id, b.dst FROM r JOIN b ON r.other = b.src) SELECT id, min(other) AS component FROM r GROUP BY id""")
def graph_components(spark, d):
    return graph.connected_components(links(spark, d))


@query("graph_strong_components", f"""WITH RECURSIVE {LINKS_SQL}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src)
SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def graph_strong_components(spark, d):
    return graph.strong_components(links(spark, d))


@query("graph_shortest_paths", f"""WITH RECURSIVE {PARTS_SQL}, w AS (SELECT src, dst, 1 + (src + dst) % 5 AS w FROM edges),
r(id, dist) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT w.dst, r.dist + w.w FROM r JOIN w ON r.id = w.src) SELECT id, min(dist)::DOUBLE AS dist FROM r GROUP BY id""")
def graph_shortest_paths(spark, d):
    e = parts(spark, d).withColumn("w", 1 + (F.col("src") + F.col("dst")) % 5)
    return graph.shortest_paths(e, one(spark), "w").select("id", "dist")


@query("graph_topological_levels", f"""WITH RECURSIVE {PARTS_SQL.replace("FROM part WHERE", "FROM part WHERE p_partkey > 0 AND")}, r(id, l) AS (SELECT src, 0 FROM edges UNION SELECT dst, l + 1 FROM r JOIN edges ON id = src)
SELECT id, max(l)::INT AS level FROM r GROUP BY id""")
def graph_topological_levels(spark, d):
    return graph.topological_levels(parts(spark, d).where("src > 0"))


_BOTH = "b AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"


def friends(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    near = joins.interval_join(c, c, "c_custkey", ["c_nationkey"], 200)
    return near.where("left_c_custkey < right_c_custkey").select(F.col("left_c_custkey").alias("src"), F.col("right_c_custkey").alias("dst"))


FRIENDS_SQL = ("edges AS (SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b "
               "ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND b.c_custkey <= a.c_custkey + 200)")


@query("graph_triangles", f"WITH {FRIENDS_SQL} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = x.src AND z.dst = y.dst")
def graph_triangles(spark, d):
    return graph.triangles(friends(spark, d))


@query("graph_clustering", f"""WITH {FRIENDS_SQL}, {_BOTH}, t AS (SELECT x.src AS id, count(*) // 2 AS t FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src AND z.dst = x.src GROUP BY x.src),
g AS (SELECT src AS id, count(*) AS d FROM b GROUP BY src)
SELECT id, coalesce(t, 0)::BIGINT AS triangles, round(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 9) AS coefficient FROM g LEFT JOIN t USING (id)""")
def graph_clustering(spark, d):
    return graph.clustering(friends(spark, d)).withColumn("coefficient", F.round("coefficient", 9))


@query("graph_two_hop", f"WITH {PARTS_SQL} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src")
def graph_two_hop(spark, d):
    return graph.match_path(parts(spark, d).distinct(), ["a", "b", "c"])


@query("graph_variable_paths", f"""WITH RECURSIVE {PARTS_SQL}, r(start, finish, hops, path) AS (SELECT 1::BIGINT, 1::BIGINT, 0, [1::BIGINT]
UNION ALL SELECT start, dst, hops + 1, list_append(path, dst) FROM r JOIN edges ON finish = src WHERE hops < 4 AND NOT list_contains(path, dst))
SELECT finish, hops, array_to_string(path, '>') AS path FROM r WHERE hops BETWEEN 2 AND 4""")
def graph_variable_paths(spark, d):
    out = graph.variable_paths(parts(spark, d), one(spark), 2, 4)
    return out.select("finish", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("graph_closure", f"""WITH RECURSIVE {PARTS_SQL}, r(s, f, n) AS (SELECT src, dst, 1 FROM edges UNION SELECT s, dst, n + 1 FROM r JOIN edges ON f = src WHERE n < 3)
SELECT s AS start, f AS finish, min(n)::INT AS dist FROM r WHERE s <> f GROUP BY 1, 2""")
def graph_closure(spark, d):
    return graph.closure(parts(spark, d), high=3)


# Twelve rounds, each a common table; mass of vertices without edges out is dealt out evenly.
_RANKS = ", ".join(f"""r{i} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(f, 0) + (1 - total) / n) AS rank FROM v CROSS JOIN size CROSS JOIN
(SELECT sum(rank * p) AS total FROM r{i - 1} JOIN w ON r{i - 1}.id = w.src) LEFT JOIN (SELECT dst, sum(rank * p) AS f FROM r{i - 1} JOIN w ON r{i - 1}.id = w.src GROUP BY dst) ON v.id = dst)"""
                   for i in range(1, 13))


@query("graph_pagerank", f"""WITH {LINKS_SQL}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), size AS (SELECT count(*) AS n FROM v),
w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM edges), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v CROSS JOIN size), {_RANKS} SELECT id, round(rank, 9) AS rank FROM r12""")
def graph_pagerank(spark, d):
    return graph.pagerank(links(spark, d), max_iter=12, tol=0).select("id", F.round("rank", 9).alias("rank"))


_WEIGHTED = "w AS (SELECT src, dst, 1 + (src + dst) % 5 AS w FROM edges WHERE src <> dst)"
_UNIT = "w AS (SELECT src, dst, 1 AS w FROM edges WHERE src <> dst)"
_PATHS = """p(s, t, cost, path) AS (SELECT src, dst, w::BIGINT, [src, dst] FROM w UNION ALL SELECT s, w.dst, cost + w.w, list_append(path, w.dst) FROM p JOIN w ON p.t = w.src WHERE NOT list_contains(path, w.dst)),
short AS (SELECT *, count(*) OVER (PARTITION BY s, t) AS n FROM (SELECT *, min(cost) OVER (PARTITION BY s, t) AS least FROM p) WHERE cost = least)"""
_BETWEEN = f"""{_PATHS}, got AS (SELECT unnest(path[2:-2]) AS id, 1.0::DOUBLE / n AS part FROM short), v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT id, round(coalesce(sum(part), 0), 6) AS score FROM v LEFT JOIN got USING (id) GROUP BY id"""


def weighted(spark, d):
    return parts(spark, d).distinct().withColumn("w", 1 + (F.col("src") + F.col("dst")) % 5)


@query("graph_betweenness", f"WITH RECURSIVE {PARTS_SQL}, {_UNIT}, {_BETWEEN}")
def graph_betweenness(spark, d):
    return graph.betweenness(parts(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("graph_weighted_betweenness", f"WITH RECURSIVE {PARTS_SQL}, {_WEIGHTED}, {_BETWEEN}")
def graph_weighted_betweenness(spark, d):
    return graph.betweenness(weighted(spark, d), weight="w").select("id", F.round("score", 6).alias("score"))


@query("graph_edge_betweenness", f"""WITH RECURSIVE {PARTS_SQL}, {_UNIT}, {_PATHS}, got AS (SELECT path[i] AS src, path[i + 1] AS dst, 1.0::DOUBLE / n AS part FROM short, unnest(range(1, len(path))) AS t(i))
SELECT w.src, w.dst, round(coalesce(sum(part), 0), 6) AS score FROM w LEFT JOIN got ON w.src = got.src AND w.dst = got.dst GROUP BY 1, 2""")
def graph_edge_betweenness(spark, d):
    return graph.edge_betweenness(parts(spark, d)).select("src", "dst", F.round("score", 6).alias("score"))


@query("graph_all_pairs", f"WITH RECURSIVE {PARTS_SQL}, {_WEIGHTED}, {_PATHS} SELECT s AS start, t AS finish, min(cost)::DOUBLE AS dist FROM p GROUP BY 1, 2")
def graph_all_pairs(spark, d):
    return graph.all_pairs(weighted(spark, d), weight="w").where("start <> finish").select("start", "finish", "dist")


@query("graph_a_star", f"""WITH RECURSIVE {PARTS_SQL}, {_WEIGHTED}, {_PATHS}
SELECT min(cost)::DOUBLE AS dist FROM p WHERE s = 1 AND t = (SELECT max(t) FROM p WHERE s = 1)""")
def graph_a_star(spark, d):
    # An edge multiplies the key by about three at most, and costs one at least: a bound on what is left to the goal.
    e = weighted(spark, d)
    goal = graph.bfs(e, one(spark)).agg(F.max("id")).first()[0] if not e.isEmpty() else 0
    left = F.greatest(F.lit(0.0), F.floor(F.log((F.lit(goal) + 0.5) / (F.col("id") + 0.5)) / F.log(F.lit(3.0))).cast("double"))
    return graph.a_star(e, 1, goal, left, weight="w").where(F.col("id") == goal).select("dist")


# ---- triples: customers and nations -------------------------------------------------------------

def _iri(kind, key):
    return F.concat(F.lit(f"<http://example.org/{kind}/"), key.cast("string"), F.lit(">"))


NAME, NATION, REGION, SEGMENT = (f"<http://example.org/p/{n}>" for n in ("name", "nation", "region", "segment"))


def rdf(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    who, nation = _iri("customer", F.col("c_custkey")), _iri("nation", F.col("c_nationkey"))
    rows = [c.select(who.alias("s"), F.lit(NAME).alias("p"), triples.literal(F.col("c_name")).alias("o")), c.select(who, F.lit(NATION), nation),
            c.select(who, F.lit(SEGMENT), triples.literal(F.col("c_mktsegment"))),
            n.select(_iri("nation", F.col("n_nationkey")), F.lit(REGION), _iri("region", F.col("n_regionkey"))), n.select(_iri("nation", F.col("n_nationkey")), F.lit(NAME), triples.literal(F.col("n_name")))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query("rdf_basic_pattern", "SELECT '\"' || c_name || '\"' AS who, '\"' || n_name || '\"' AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def rdf_basic_pattern(spark, d):
    t = rdf(spark, d)
    return triples.basic_pattern(t, [("?n", REGION, "<http://example.org/region/1>"), ("?c", NATION, "?n"), ("?c", NAME, "?who"), ("?n", NAME, "?nation")]).select("who", "nation")


@query("rdf_optional_filter", "SELECT n_name AS nation, c_custkey AS c FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_nationkey = n_nationkey")
def rdf_optional_filter(spark, d):
    t = rdf(spark, d)
    names = triples.basic_pattern(t, [("?n", REGION, "?r"), ("?n", NAME, "?nation")])
    builders = triples.basic_pattern(t, [("?c", SEGMENT, '"BUILDING"'), ("?c", NATION, "?n")])
    builders = builders.withColumn("c", F.regexp_extract("c", r"(\d+)>$", 1).cast("long"))
    return triples.optional(names, builders).select(triples.lexical(F.col("nation")).alias("nation"), "c")


@query("rdf_union_minus", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3")
def rdf_union_minus(spark, d):
    t = rdf(spark, d)
    either = triples.union(triples.match(t, "?c", SEGMENT, '"BUILDING"'), triples.match(t, "?c", SEGMENT, '"MACHINERY"'))
    out = triples.minus(either, triples.match(t, "?c", NATION, "<http://example.org/nation/3>"))
    return out.select(F.regexp_extract("c", r"(\d+)>$", 1).cast("long").alias("c"))


@query("rdf_path_sequence_group", "SELECT n_regionkey::BIGINT AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rdf_path_sequence_group(spark, d):
    t = rdf(spark, d)
    path = triples.sequence(triples.step(t, NATION), triples.step(t, REGION))
    return path.groupBy(F.regexp_extract("dst", r"(\d+)>$", 1).cast("long").alias("region")).agg(F.count("*").alias("n"))


@query("rdf_construct_terms", "SELECT DISTINCT 'customer/' || c_custkey AS s, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rdf_construct_terms(spark, d):
    t = rdf(spark, d)
    made = triples.construct(triples.basic_pattern(t, [("?c", NATION, "?n"), ("?n", NAME, "?nation")]), [("?c", "<http://example.org/p/lives>", "?nation")])
    return made.select(F.regexp_replace(triples.lexical(F.col("s")), "http://example.org/", "").alias("s"), triples.lexical(F.col("o")).alias("o"))


# ---- temporal: versions of a customer's latest order status -------------------------------------

def versions(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").alias("sys_from")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return temporal.close_versions(rows, ["o_custkey"])


VERSIONS_SQL = "v AS (SELECT o_custkey, o_orderdate AS sys_from, max(o_orderkey) AS o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS sys_to FROM orders GROUP BY o_custkey, o_orderdate)"


@query("temporal_as_of", f"WITH {VERSIONS_SQL} SELECT o_custkey, o_orderkey FROM v WHERE sys_from <= TIMESTAMP '1997-01-01' AND (sys_to IS NULL OR sys_to > TIMESTAMP '1997-01-01')")
def temporal_as_of(spark, d):
    return temporal.as_of(versions(spark, d), F.expr("timestamp_ntz'1997-01-01'")).select("o_custkey", "o_orderkey")


@query("temporal_between", f"WITH {VERSIONS_SQL} SELECT o_custkey, o_orderkey FROM v WHERE sys_from < TIMESTAMP '1997-03-01' AND (sys_to IS NULL OR sys_to > TIMESTAMP '1997-01-01')")
def temporal_between(spark, d):
    from datetime import datetime

    return temporal.between(versions(spark, d), datetime(1997, 1, 1), datetime(1997, 3, 1)).select("o_custkey", "o_orderkey")


@query("temporal_history_chain", f"WITH {VERSIONS_SQL} SELECT o_custkey, count(*) AS n, count(sys_to) AS closed FROM v GROUP BY o_custkey")
def temporal_history_chain(spark, d):
    return versions(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count("sys_to").alias("closed"))


@query("store_multi_get_delete_range", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey * 3 FROM supplier) AND NOT (c_custkey >= 100 AND c_custkey < 200)")
def store_multi_get_delete_range(spark, d):
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"))
    return temporal.delete_range(temporal.multi_get(table(spark, d, "customer"), wanted, ["c_custkey"]), "c_custkey", 100, 200).select("c_custkey")
