"""Relational queries: scans, filters, joins, aggregation, sorting, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.register import Group
from tessera.operators import joins
from tessera.session import table

QUERIES = Group()
query, sql = QUERIES.query, QUERIES.sql


@query("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def tpch_q1(spark, d):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, d, "lineitem")
        .where("l_shipdate <= timestamp_ntz'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(disc), 2).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


# TPC-H by intent, on the tables at hand (there is no partsupp).
sql("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
sql("tpch_q4", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""")
sql("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
sql("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql("tpch_q7", """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY 1, 2, 3""")
sql("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("tpch_q12", """
SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count,
       sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""",
    """SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high_line_count,
       sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""")
sql("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count""")
sql("tpch_q14", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
       / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey""")
sql("tpch_q15", """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")
sql("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""")
sql("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""")
sql("tpch_q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_nationkey""")

# Projection, filters and predicates.
sql("filter_expression", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.02) OR l_tax = 0.08")
sql("filter_like_regex", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7' OR c_mktsegment RLIKE '^(AUTO|MACH)'",
    "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%7' OR regexp_matches(c_mktsegment, '^(AUTO|MACH)')")
sql("filter_in_between_distinct", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 90000
AND o_orderpriority IS DISTINCT FROM '1-URGENT' AND o_custkey IS NOT NULL""")
sql("case_coalesce_cast", """
SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code,
       CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band,
       coalesce(nullif(event_type, 'click'), 'c') AS kind, CAST(floor(value) AS BIGINT) AS whole FROM events""")
sql("try_cast_values", """
SELECT n, try_cast(s AS INT) AS i FROM (VALUES (1, '12'), (2, 'x'), (3, NULL)) AS v(n, s)""")
sql("json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("variant_field", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("flat_map_words", "SELECT doc_id, count(*) AS words FROM (SELECT doc_id, explode(split(text, ' ')) AS w FROM documents) t WHERE w <> '' GROUP BY doc_id",
    "SELECT doc_id, count(*) AS words FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) t WHERE w <> '' GROUP BY doc_id")
sql("unnest_with_position", "SELECT item_id, pos, w FROM benchmark LATERAL VIEW posexplode(split(text, ' ')) t AS pos, w",
    "SELECT item_id, (i - 1)::INT AS pos, ws[i] AS w FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), unnest(range(1, len(ws) + 1)) AS t(i)")
sql("lateral_top_orders", """
SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (
  SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t""")
sql("recursive_cte", """
WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r""")
sql("scalar_and_in_subqueries", """
SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
AND s_acctbal > (SELECT avg(s_acctbal) FROM supplier)""")
sql("null_aware_not_in", """
SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 3 END FROM customer)""")

# Joins.
sql("join_inner_two_keys", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey % 100")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT s_suppkey, c_custkey FROM customer RIGHT JOIN supplier ON c_custkey = s_suppkey * 3")
sql("join_full", "SELECT a.c_custkey AS x, b.s_suppkey AS y FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey * 2")
sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_natural_using", "SELECT n_nationkey, n_name, total FROM nation JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS total FROM customer GROUP BY c_nationkey) t USING (n_nationkey)")
sql("join_existence_or", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)""")

# Aggregation.
# Two distinct sets in one aggregation would triple the rows; each has a branch of its own here.
sql("group_distinct", """
SELECT l_suppkey, parts, n, q FROM (SELECT l_suppkey, count(l_partkey) AS parts, sum(c) AS n FROM (SELECT l_suppkey, l_partkey, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY l_suppkey)
JOIN (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS q FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem) GROUP BY k) ON l_suppkey <=> k""",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS n, round(sum(DISTINCT l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey")
sql("agg_filter", """
SELECT event_type, count(*) FILTER (WHERE value > 20) AS big, round(avg(value) FILTER (WHERE user_id % 2 = 0), 6) AS even FROM events GROUP BY event_type""")
sql("agg_ordered_list", """
SELECT user_id, array_join(transform(array_sort(collect_list(struct(ts, event_id))), x -> CAST(x.event_id AS STRING)), ',') AS ids FROM events GROUP BY user_id""",
    "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
sql("agg_listagg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_first_last", "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, max_by(value, struct(ts, event_id)) AS last_value FROM events GROUP BY user_id",
    "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
sql("agg_min_max_n", "SELECT c_nationkey, concat_ws(',', transform(slice(sort_array(collect_list(c_custkey), false), 1, 3), x -> CAST(x AS STRING))) AS top FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, array_to_string(max(c_custkey, 3), ',') AS top FROM customer GROUP BY c_nationkey")
sql("agg_statistics", """
SELECT event_type, round(var_samp(value), 6) AS vs, round(stddev_pop(value), 6) AS sp, round(corr(value, user_id), 6) AS c, round(covar_pop(value, user_id), 4) AS cv,
       percentile(value, 0.5) AS med FROM events GROUP BY event_type""",
    """SELECT event_type, round(var_samp(value), 6) AS vs, round(stddev_pop(value), 6) AS sp, round(corr(value, user_id), 6) AS c, round(covar_pop(value, user_id), 4) AS cv,
       quantile_cont(value, 0.5) AS med FROM events GROUP BY event_type""")
sql("grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS gid FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""")
sql("rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("group_by_all_having", "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 20")
sql("merge_operators", """
SELECT user_id, round(sum(value), 6) AS added, max(value) AS greatest, min(value) AS least, array_join(array_sort(collect_set(event_type)), ',') AS kinds FROM events GROUP BY user_id""",
    """SELECT user_id, round(sum(value), 6) AS added, max(value) AS greatest, min(value) AS least, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id""")
sql("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (round(sum(l_quantity), 2) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
    "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f FROM lineitem GROUP BY 1")
sql("unpivot", "SELECT * FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR k IN (nation, balance))",
    "UNPIVOT (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) ON nation, balance INTO NAME k VALUE v")

# Sort, limit, top-k.
sql("sort_nulls_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
sql("distinct_on_latest_order", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) t WHERE r = 1""",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


@query("limit_percent", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= floor(n * 0.02)")
def limit_percent(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    placed = joins.row_positions(orders, [F.col("o_totalprice").desc(), "o_orderkey"], "pos")
    return placed.where(F.col("pos") < int(orders.count() * 0.02)).drop("pos")


# Set operations.
sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")


@query("union_by_name", "SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL BY NAME SELECT s_acctbal AS balance, s_suppkey AS k FROM supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


@query("fold_with_initial_value", "SELECT user_id, round(100 + sum(value), 6) AS folded FROM events GROUP BY user_id")
def fold_with_initial_value(spark, d):
    # Addition is associative, so the fold is reduced in the tasks first and takes its initial value once.
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.lit(100.0) + F.sum("value"), 6).alias("folded"))


@query("feature_pipeline", """
SELECT u.user_id, n, round(total, 4) AS total, round(total / n, 6) AS mean, rank() OVER (ORDER BY round(total, 4) DESC) AS place
FROM (SELECT user_id, count(*) AS n, sum(value) AS total FROM events WHERE value > 1 GROUP BY user_id) u""")
def feature_pipeline(spark, d):
    per_user = table(spark, d, "events").where("value > 1").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = per_user.select("user_id", "n", F.round("total", 4).alias("total"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))
    return joins.global_rank(rows, [F.col("total").desc()], "place")
