"""Streaming queries over ``events``, drained and compared with batch results; change capture and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import sources
from tessera.plans.register import Group
from tessera.session import table
from tessera.streaming import windows as streaming

QUERIES = Group()
query = QUERIES.query


def _events(spark, d):
    return streaming.stream_table(spark, f"{d}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))


def _aggs():
    return {"n": F.count("*"), "total": F.round(F.sum("value"), 6)}


@query("stream_tumbling_append", """
SELECT event_type, s AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS s FROM events)
GROUP BY 1, 2 HAVING s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 5 SECONDS FROM events)""")
def stream_tumbling_append(spark, d):
    out = streaming.drain(streaming.continuous_aggregate(_events(spark, d), "t", "1 day", _aggs(), ["event_type"]))
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("stream_sliding_complete", """
SELECT make_timestamp(b * 43200000000) AS window_start, count(*) AS n, round(sum(value), 6) AS total
FROM (SELECT value, unnest(range(epoch_us(ts) // 43200000000 - 1, epoch_us(ts) // 43200000000 + 1)) AS b FROM events) GROUP BY 1""")
def stream_sliding_complete(spark, d):
    out = streaming.drain(streaming.windows.window_aggregate(_events(spark, d), "t", "1 day", _aggs(), slide="12 hours"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("stream_deduplicate", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicate(spark, d):
    return streaming.drain(streaming.deduplicate(_events(spark, d), ["user_id", "event_type"], "t", "365 days").select("user_id", "event_type"))


@query("stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return streaming.drain(_events(spark, d).where("event_type = 'purchase'").join(customers, "user_id").select("event_id", "c_mktsegment"))


@query("stream_interval_join", """
SELECT a.event_id AS purchase, b.event_id AS click FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000
WHERE a.event_type = 'purchase' AND b.event_type = 'click'""")
def stream_interval_join(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "event_type", "t")
    out = streaming.interval_join(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "t", ["user_id"], "6 HOURS")
    return streaming.drain(out.select(F.col("left_event_id").alias("purchase"), F.col("right_event_id").alias("click")))


@query("stream_running_sum", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_running_sum(spark, d):
    out = streaming.drain(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "complete")
    return out.select("event_type", "n", F.round("total", 4).alias("total"))


@query("cdc_merge", """
SELECT c_custkey, CASE WHEN o IS NULL THEN c_acctbal ELSE o END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1)
ON c_custkey = o_custkey WHERE st IS NULL OR st <> 'P'""")
def cdc_merge(spark, d):
    target = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    changes = table(spark, d, "orders").join(target, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    changes = changes.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "d").otherwise("u").alias("op"))
    return sources.merge_changes(target, changes, ["c_custkey"], ["o_orderdate", "o_orderkey"])


@query("sink_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def sink_round_trip(spark, d):
    base = streaming.shared_folder(spark, "sink")
    nation = table(spark, d, "nation")
    sources.write(nation, f"{base}/n.csv")
    sources.write(sources.read(spark, f"{base}/n.csv", schema=nation.schema), f"{base}/n.json")
    sources.write(sources.read(spark, f"{base}/n.json", schema=nation.schema), f"{base}/n.parquet", partition_by=["n_regionkey"])
    return sources.read(spark, f"{base}/n.parquet", columns=["n_nationkey", "n_name", "n_regionkey"], where="n_regionkey IN (1, 3)")


@query("stream_keyed_state", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def stream_keyed_state(spark, d):
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        out = streaming.drain(streaming.keyed_fold(_events(spark, d).select("event_type", "value"), "event_type", "value"), "update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "total", "low", "high"), "batch").alias("r"))
    return last.select("event_type", "r.n", F.round("r.total", 4).alias("total"), "r.low", "r.high")
