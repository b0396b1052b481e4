"""SQL statements beside SELECT, window functions of the SQL front end, summaries, samples and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import summary
from tessera.operators import graph, temporal, triples
from tessera.plans import graphs
from tessera.plans.register import Group, run_sql
from tessera.session import table
from tessera.streaming.windows import shared_folder

QUERIES = Group()
query, sql = QUERIES.query, QUERIES.sql

sql("sql_tumble", "SELECT window.start AS window_start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 day'), event_type",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
sql("sql_hop", "SELECT window.start AS window_start, count(*) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')",
    """SELECT make_timestamp(b * 3600000000) AS window_start, count(*) AS n
FROM (SELECT unnest(range(epoch_us(ts) // 3600000000 - 1, epoch_us(ts) // 3600000000 + 1)) AS b FROM events) GROUP BY 1""")
sql("generate_series", "SELECT explode(sequence(TIMESTAMP_NTZ'1997-01-01 00:00:00', TIMESTAMP_NTZ'1997-02-01 00:00:00', INTERVAL '6' HOUR)) AS t",
    "SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-02-01', INTERVAL 6 HOUR)) AS t")


@query("sql_macro", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def sql_macro(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return run_sql(spark, d, "SELECT l_orderkey, l_linenumber, round(tessera_net(l_extendedprice, l_discount), 4) AS net FROM lineitem")


@query("sql_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def sql_parameters(spark, d):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status",
                     args={"least": 100000.0, "status": "F"}, orders=table(spark, d, "orders"))


@query("sql_create_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (0, 4)")
def sql_create_insert(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    spark.sql("DROP TABLE IF EXISTS tessera_nations")
    spark.sql(f"CREATE TABLE tessera_nations USING parquet PARTITIONED BY (n_regionkey) LOCATION '{shared_folder(spark, 'nations')}/t' AS "
              "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
    spark.sql("INSERT INTO tessera_nations SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 4")
    return spark.table("tessera_nations")


@query("column_summary", """
SELECT 'l_quantity' AS name, count(l_quantity) AS n, count(*) - count(l_quantity) AS nulls, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), count(*) - count(l_tax), min(l_tax), max(l_tax), round(avg(l_tax), 6) FROM lineitem""")
def column_summary(spark, d):
    return summary.column_summary(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumn("mean", F.round("mean", 6))


@query("sample_bernoulli")
def sample_bernoulli(spark, d):
    return summary.bernoulli_sample(table(spark, d, "orders").select("o_orderkey"), 0.1, seed=7)


@query("sample_reservoir", "SELECT least(100, (SELECT count(*) FROM orders)) AS n")
def sample_reservoir(spark, d):
    rows = summary.reservoir_sample(table(spark, d, "orders").select("o_orderkey"), 100, seed=7)
    return rows.agg(F.count_distinct("o_orderkey").alias("n"))


@query("ml_kmeans")
def ml_kmeans(spark, d):
    return summary.kmeans(table(spark, d, "embeddings"), 8).select("vec_id", "cluster")


@query("graph_diamonds", f"""WITH {graphs.PARTS_SQL} SELECT x.src AS a, x.dst AS b, y.dst AS c, z.dst AS d FROM edges x JOIN edges y ON x.src = y.src AND x.dst < y.dst
JOIN edges z ON z.src = x.dst JOIN edges w ON w.src = y.dst AND w.dst = z.dst""")
def graph_diamonds(spark, d):
    return graph.diamonds(graphs.parts(spark, d))


@query("graph_multi_source_bfs", f"""WITH RECURSIVE {graphs.PARTS_SQL}, r(id, dist) AS (SELECT unnest([1, 5])::BIGINT, 0 UNION SELECT dst, dist + 1 FROM r JOIN edges ON id = src WHERE dist < 30)
SELECT id, min(dist)::INT AS dist FROM r GROUP BY id""")
def graph_multi_source_bfs(spark, d):
    return graph.bfs(graphs.parts(spark, d), graphs.one(spark, 1).union(graphs.one(spark, 5))).select("id", "dist")


@query("rdf_negated_path", """
SELECT DISTINCT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS o FROM customer
UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation""")
def rdf_negated_path(spark, d):
    path = triples.negated(graphs.rdf(spark, d), [graphs.NAME, graphs.SEGMENT]).distinct()
    return path.select(*[F.regexp_extract(c, r"org/([a-z]+/\d+)>$", 1).alias(name) for c, name in (("src", "s"), ("dst", "o"))])


_RING = "nation_ring AS (SELECT n_nationkey AS a, (n_nationkey // 5) * 5 + (n_nationkey + 1) % 5 AS b FROM nation WHERE n_nationkey % 5 <> 4)"


def _key(column, name):
    return F.regexp_extract(column, r"/(\d+)>$", 1).cast("long").alias(name)


def _ring(spark, d):
    """Nations of each five lead to the next, as triples beside the others."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).where("k % 5 <> 4")
    return n.select(graphs._iri("nation", F.col("k")).alias("s"), F.lit("<http://example.org/p/next>").alias("p"), graphs._iri("nation", F.col("k") + 1).alias("o"))


@query("rdf_inverse_path", "SELECT n_regionkey::BIGINT AS region, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rdf_inverse_path(spark, d):
    t = graphs.rdf(spark, d)
    path = triples.sequence(triples.inverse(triples.step(t, graphs.REGION)), triples.inverse(triples.step(t, graphs.NATION)))
    return path.select(_key("src", "region"), _key("dst", "c"))


@query("rdf_alternative_path", "SELECT c_custkey AS c, 'nation' AS kind FROM customer UNION ALL SELECT c_custkey, 'segment' FROM customer")
def rdf_alternative_path(spark, d):
    t = graphs.rdf(spark, d)
    path = triples.alternative(triples.step(t, graphs.NATION), triples.step(t, graphs.SEGMENT))
    return path.select(_key("src", "c"), F.when(triples.is_iri(F.col("dst")), "nation").otherwise("segment").alias("kind"))


@query("rdf_one_or_more", f"WITH {_RING}, r AS (SELECT x.a, y.b FROM nation_ring x JOIN nation_ring y ON y.a >= x.a AND y.a // 5 = x.a // 5) SELECT a::BIGINT AS a, b::BIGINT AS b FROM r")
def rdf_one_or_more(spark, d):
    return triples.one_or_more(triples.step(_ring(spark, d), "<http://example.org/p/next>")).select(_key("src", "a"), _key("dst", "b"))


@query("rdf_zero_or_more", f"WITH {_RING} SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x JOIN nation y ON y.n_nationkey >= x.n_nationkey AND y.n_nationkey // 5 = x.n_nationkey // 5")
def rdf_zero_or_more(spark, d):
    return triples.zero_or_more(triples.step(_ring(spark, d), "<http://example.org/p/next>")).select(_key("src", "a"), _key("dst", "b"))


@query("rdf_terms", """SELECT c_custkey AS c, c_name AS text, true AS literal, false AS iri, 'http://www.w3.org/2001/XMLSchema#string' AS kind, length(c_name)::BIGINT AS n, upper(c_name) AS up FROM customer
UNION ALL SELECT c_custkey, 'http://example.org/nation/' || c_nationkey, false, true, NULL, length('http://example.org/nation/' || c_nationkey), upper('http://example.org/nation/' || c_nationkey) FROM customer""")
def rdf_terms(spark, d):
    t = graphs.rdf(spark, d).where(F.col("s").contains("/customer/") & F.col("p").isin(graphs.NAME, graphs.NATION))
    o, text = F.col("o"), triples.lexical(F.col("o"))
    return t.select(_key("s", "c"), text.alias("text"), triples.is_literal(o).alias("literal"), triples.is_iri(o).alias("iri"), triples.datatype(o).alias("kind"),
                    F.char_length(text).cast("long").alias("n"), F.upper(text).alias("up"))


@query("rdf_optional_chain", """
SELECT n_nationkey::BIGINT AS n, min_key AS c, seg FROM nation LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS min_key FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey
JOIN (SELECT c_custkey, c_mktsegment AS seg FROM customer) ON c_custkey = min_key
UNION ALL SELECT n_nationkey, c_custkey, c_mktsegment FROM nation CROSS JOIN customer WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def rdf_optional_chain(spark, d):
    # A variable that OPTIONAL leaves unbound agrees with every value of the next pattern.
    t = graphs.rdf(spark, d)
    builders = triples.basic_pattern(t, [("?c", graphs.SEGMENT, '"BUILDING"'), ("?c", graphs.NATION, "?n")])
    first = builders.groupBy("n").agg(F.min_by("c", _key("c", "k")).alias("c"))
    found = triples.optional(triples.match(t, "?n", graphs.REGION, "?r").select("n"), first)
    out = triples.join_solutions(found, triples.match(t, "?c", graphs.SEGMENT, "?seg"), unbound=["c"])
    return out.select(_key("n", "n"), _key("c", "c"), triples.lexical(F.col("seg")).alias("seg"))


@query("bitemporal_as_of", f"""WITH {graphs.VERSIONS_SQL} SELECT o_custkey, o_orderkey FROM v JOIN (SELECT o_orderkey AS k, o_orderdate + INTERVAL 30 DAY AS valid_from FROM orders) ON k = o_orderkey
WHERE sys_from <= TIMESTAMP '1997-06-01' AND (sys_to IS NULL OR sys_to > TIMESTAMP '1997-06-01') AND valid_from <= TIMESTAMP '1997-05-01' AND valid_from + INTERVAL 400 DAY > TIMESTAMP '1997-05-01'""")
def bitemporal_as_of(spark, d):
    rows = graphs.versions(spark, d)
    rows = rows.withColumn("valid_from", F.col("sys_from") + F.expr("interval 30 days")).withColumn("valid_to", F.col("sys_from") + F.expr("interval 430 days"))
    return temporal.as_of(rows, F.expr("timestamp_ntz'1997-06-01'"), F.expr("timestamp_ntz'1997-05-01'")).select("o_custkey", "o_orderkey")


@query("merge_update_delete", """
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 5
UNION ALL SELECT s_suppkey + 100000000, s_acctbal FROM supplier""")
def merge_update_delete(spark, d):
    # Change events: update one nation, delete another, insert the suppliers.
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    target = c.select("c_custkey", "c_acctbal")
    changes = c.where("c_nationkey = 3").select("c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal"), F.lit("u").alias("op"), F.lit(1).alias("seq"))
    changes = changes.union(c.where("c_nationkey = 5").select("c_custkey", "c_acctbal", F.lit("d"), F.lit(2)))
    changes = changes.union(s.select(F.col("s_suppkey") + 100_000_000, "s_acctbal", F.lit("c"), F.lit(1)))
    return sources.merge_changes(target, changes, ["c_custkey"], ["seq"])


@query("udaf_geometric_mean", "SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS mean FROM events GROUP BY event_type")
def udaf_geometric_mean(spark, d):
    # An aggregate of one's own with a partial step: each task folds its batches into sums, which are merged after the shuffle.
    def fold(batches):
        for batch in batches:
            logs = batch.assign(total=np.log(batch["value"] + 1), n=1).groupby("event_type", as_index=False)[["total", "n"]].sum()
            yield logs

    parts = table(spark, d, "events").select("event_type", "value").mapInPandas(fold, "event_type string, total double, n long")
    return parts.groupBy("event_type").agg(F.round(F.exp(F.sum("total") / F.sum("n")), 6).alias("mean"))


@query("rdf_exists", "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rdf_exists(spark, d):
    t = graphs.rdf(spark, d)
    builders = triples.basic_pattern(t, [("?c", graphs.SEGMENT, '"BUILDING"'), ("?c", graphs.NATION, "?n")])
    found = triples.exists(triples.match(t, "?n", graphs.REGION, "?r"), builders)
    return found.select(F.regexp_extract("n", r"(\d+)>$", 1).cast("long").alias("n"))
