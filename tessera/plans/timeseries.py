"""Queries over event time: as-of and interval joins, windows, resampling, window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tessera.operators import joins, windows
from tessera.plans.register import Group
from tessera.session import table

QUERIES = Group()
query, sql = QUERIES.query, QUERIES.sql

_TRADES = "(SELECT user_id, ts, max(event_id) AS trade_id, round(max(value), 6) AS price FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)"
_QUOTES = "(SELECT user_id, ts, max(event_id) AS quote_id, round(max(value), 6) AS bid FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts)"


def _trades(spark, d):
    rows = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", "ts")
    return rows.agg(F.max("event_id").alias("trade_id"), F.round(F.max("value"), 6).alias("price"))


def _quotes(spark, d):
    rows = table(spark, d, "events").where("event_type <> 'purchase'").groupBy("user_id", "ts")
    return rows.agg(F.max("event_id").alias("quote_id"), F.round(F.max("value"), 6).alias("bid"))


@query("asof_backward", f"SELECT t.trade_id, t.price, q.quote_id, q.bid FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_backward(spark, d):
    return joins.asof_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], prefix="q_").select("trade_id", "price", F.col("q_quote_id").alias("quote_id"), F.col("q_bid").alias("bid"))


@query("asof_backward_bucketed", f"SELECT t.trade_id, q.quote_id FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_backward_bucketed(spark, d):
    out = joins.asof_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], bucket=7 * 86400, prefix="q_")
    return out.select("trade_id", F.col("q_quote_id").alias("quote_id"))


@query("asof_forward", f"SELECT t.trade_id, q.quote_id FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts <= q.ts")
def asof_forward(spark, d):
    return joins.asof_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], direction="forward", prefix="q_").select("trade_id", F.col("q_quote_id").alias("quote_id"))


@query("asof_tolerance", f"""
SELECT t.trade_id, CASE WHEN epoch_us(t.ts) - epoch_us(q.ts) <= 21600000000 THEN q.quote_id END AS quote_id
FROM {_TRADES} t ASOF LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts""")
def asof_tolerance(spark, d):
    return joins.asof_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], tolerance=21600, prefix="q_").select("trade_id", F.col("q_quote_id").alias("quote_id"))


@query("temporal_versioned_join", f"SELECT t.trade_id, q.quote_id AS version FROM {_TRADES} t ASOF JOIN {_QUOTES} q ON t.user_id = q.user_id AND t.ts >= q.ts")
def temporal_versioned_join(spark, d):
    return joins.temporal_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"]).select("trade_id", F.col("table_quote_id").alias("version"))


@query("interval_join", f"""
SELECT t.trade_id, q.quote_id FROM {_TRADES} t JOIN {_QUOTES} q ON t.user_id = q.user_id AND abs(epoch_us(t.ts) - epoch_us(q.ts)) <= 43200000000""")
def interval_join(spark, d):
    out = joins.interval_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], 43200)
    return out.select(F.col("left_trade_id").alias("trade_id"), F.col("right_quote_id").alias("quote_id"))


@query("interval_join_left", f"""
SELECT t.trade_id, q.quote_id FROM {_TRADES} t LEFT JOIN {_QUOTES} q ON t.user_id = q.user_id AND abs(epoch_us(t.ts) - epoch_us(q.ts)) <= 3600000000""")
def interval_join_left(spark, d):
    out = joins.interval_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], 3600, "left")
    return out.select(F.col("left_trade_id").alias("trade_id"), F.col("right_quote_id").alias("quote_id"))


@query("window_join", f"""
SELECT t.trade_id, q.quote_id FROM {_TRADES} t JOIN {_QUOTES} q ON t.user_id = q.user_id AND epoch_us(t.ts) // 86400000000 = epoch_us(q.ts) // 86400000000""")
def window_join(spark, d):
    out = joins.window_join(_trades(spark, d), _quotes(spark, d), "ts", ["user_id"], "1 day")
    return out.select(F.col("left_trade_id").alias("trade_id"), F.col("right_quote_id").alias("quote_id"))


@query("range_join", """
SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, abs(s_acctbal) / 8 AS low, abs(s_acctbal) / 8 + 5 AS high FROM supplier)
ON p_retailprice BETWEEN low AND high""")
def range_join(spark, d):
    bal = F.abs("s_acctbal") / 8
    ranges = table(spark, d, "supplier").select("s_suppkey", bal.alias("low"), (bal + 5).alias("high"))
    return joins.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 10.0).select("p_partkey", "s_suppkey")


@query("positional_join", """
SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r FROM supplier)
FULL JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) USING (r)""")
def positional_join(spark, d):
    a, b = table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return joins.positional_join(a, b, ["s_acctbal", "s_suppkey"], ["c_acctbal", "c_custkey"]).select("s_suppkey", "c_custkey")


def _aggs():
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 6)}


@query("tumbling_window", """
SELECT event_type, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark, d):
    return windows.window_aggregate(table(spark, d, "events"), "ts", "1 hour", _aggs(), ["event_type"]).drop("window_end")


@query("sliding_window", """
SELECT event_type, make_timestamp(b * 21600000000) AS window_start, count(*) AS n, round(sum(value), 6) AS total
FROM (SELECT event_type, value, unnest(range(epoch_us(ts) // 21600000000 - 3, epoch_us(ts) // 21600000000 + 1)) AS b FROM events) GROUP BY 1, 2""")
def sliding_window(spark, d):
    return windows.window_aggregate(table(spark, d, "events"), "ts", "1 day", _aggs(), ["event_type"], slide="6 hours").drop("window_end")


_SESSIONS = """(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM events))"""


@query("session_window", f"SELECT user_id, min(ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM {_SESSIONS} GROUP BY user_id, session")
def session_window(spark, d):
    return windows.window_aggregate(table(spark, d, "events"), "ts", "", _aggs(), ["user_id"], gap="1 day").drop("window_end")


@query("session_numbers", f"SELECT event_id, session::BIGINT AS session FROM {_SESSIONS}")
def session_numbers(spark, d):
    return windows.session_numbers(table(spark, d, "events"), "ts", ["user_id"], 86400, "event_id").select("event_id", "session")


@query("count_window", """
SELECT user_id, w AS "window", count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS w FROM events) GROUP BY 1, 2""")
def count_window(spark, d):
    rows = windows.count_windows(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 4)
    return rows.groupBy("user_id", "window").agg(*[c.alias(n) for n, c in _aggs().items()])


@query("latest_by", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_by(spark, d):
    return windows.latest_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("first_by", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts, event_id")
def first_by(spark, d):
    return windows.earliest_by(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


_DAYS = """got AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(avg(value), 6) AS v FROM events GROUP BY 1, 2),
grid AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM got GROUP BY event_type),
filled AS (SELECT event_type, ts, v FROM grid LEFT JOIN got USING (event_type, ts))"""


def _sampled(spark, d, fill):
    return windows.sample_by(table(spark, d, "events"), "ts", "15 minutes", {"v": F.round(F.avg("value"), 6)}, ["event_type"], fill)


@query("sample_by_fill_null", f"WITH {_DAYS} SELECT * FROM filled")
def sample_by_fill_null(spark, d):
    return _sampled(spark, d, "null")


@query("sample_by_fill_prev", f"WITH {_DAYS} SELECT event_type, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts) AS v FROM filled")
def sample_by_fill_prev(spark, d):
    return _sampled(spark, d, "prev")


@query("sample_by_fill_linear", f"""WITH {_DAYS} SELECT event_type, ts, round(coalesce(v, a.v + (b.v - a.v) * (epoch_us(ts) - a.t) / (b.t - a.t)), 9) AS v FROM (
SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'t': epoch_us(ts), 'v': v}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts) AS a,
 first_value(CASE WHEN v IS NOT NULL THEN {{'t': epoch_us(ts), 'v': v}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM filled)""")
def sample_by_fill_linear(spark, d):
    return _sampled(spark, d, "linear").withColumn("v", F.round("v", 9))


# Window functions and frames.
_O = "PARTITION BY user_id ORDER BY ts, event_id"
sql("rank_functions", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr,
       round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""".replace("row_number() OVER w AS rn, ", ""))
sql("ntile_row_number", "SELECT o_orderkey, ntile(4) OVER w AS q, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
sql("lag_lead", f"SELECT event_id, lag(value, 1, 0.0) OVER w AS p, lead(event_id, 2) OVER w AS nx FROM events WINDOW w AS ({_O})")
sql("first_last_nth", f"""SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(event_id, 2) OVER w AS second
FROM events WINDOW w AS ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
sql("ignore_nulls", f"SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER w AS last_click FROM events WINDOW w AS ({_O})",
    f"SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS last_click FROM events WINDOW w AS ({_O})")
sql("rows_frame", f"SELECT event_id, round(avg(value) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS a FROM events")
sql("range_frame", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY datediff(o_orderdate, timestamp_ntz'1990-01-01') RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM orders""",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY datediff('day', TIMESTAMP '1990-01-01', o_orderdate) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM orders")
sql("distinct_window_count", "SELECT o_orderkey, CAST(size(collect_set(o_orderstatus) OVER (PARTITION BY o_custkey)) AS BIGINT) AS kinds FROM orders",
    "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS kinds FROM orders")
sql("qualify_top_two", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r <= 2",
    "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2")


@query("groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders")
def groups_frame(spark, d):
    return windows.groups_frame(F.count("*"), ["o_custkey"], F.col("o_orderpriority"), "n", table(spark, d, "orders"), -1, 0).select("o_orderkey", "n")


_WHOLE = "PARTITION BY l_suppkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query("frame_exclude", f"""
SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER ({_WHOLE} EXCLUDE CURRENT ROW), 2) AS no_row, round(sum(l_quantity) OVER ({_WHOLE} EXCLUDE GROUP), 2) AS no_group,
round(sum(l_quantity) OVER ({_WHOLE} EXCLUDE TIES), 2) AS no_ties FROM lineitem""")
def frame_exclude(spark, d):
    df, key, order = table(spark, d, "lineitem"), ["l_suppkey"], ["l_linenumber"]
    for name, kind in (("no_row", "current row"), ("no_group", "group"), ("no_ties", "ties")):
        df = windows.sum_excluding(df, "l_quantity", key, order, name, kind)
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(c) for c in ("no_row", "no_group", "no_ties")])


@query("rolling_features", """
SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS std, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW)""")
def rolling_features(spark, d):
    w = W.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-259200, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.round(F.stddev_pop("value").over(w), 6).alias("std"),
                                            F.hour("ts").alias("hour"), F.weekday("ts").alias("day_of_week"))
