"""Late and invalid rows, timers, features, dimensions and progress of streams; sources declared in SQL; Arrow and CSV files; session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import scalars
from tessera.operators import joins
from tessera.plans.register import Group
from tessera.plans.streams import _events
from tessera.session import table
from tessera.streaming import stores, windows as streaming

QUERIES = Group()
query, sql = QUERIES.query, QUERIES.sql


@query("stream_late_rows", """
SELECT event_id, event_id % 2 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 5 DAY AS late FROM events""")
def stream_late_rows(spark, d):
    # Rows of even ids arrive first; of the others, those five days behind them are late.
    base = streaming.shared_folder(spark, "late")
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    feed = spark.readStream.schema(rows.schema)

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{base}/kept/batch={n}")

    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        stream = feed.parquet(f"{base}/in")
        run = streaming.late_rows(stream, "t", "5 days", f"{base}/late", keep)
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    kept, late = (spark.read.schema("event_id long, t timestamp, batch long").parquet(f"{base}/{x}").select("event_id") for x in ("kept", "late/rows"))
    return kept.withColumn("late", F.lit(False)).union(late.withColumn("late", F.lit(True)))


@query("stream_invalid_rows", "SELECT event_id, NOT (value BETWEEN 1 AND 60) AS invalid FROM events")
def stream_invalid_rows(spark, d):
    base = streaming.shared_folder(spark, "invalid")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{base}/kept/batch={n}")

    stream = _events(spark, d).select("event_id", "value")
    run = streaming.with_dead_letters(keep, F.col("value").between(1, 60), f"{base}/aside")
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    kept, aside = (spark.read.schema("event_id long, value double, batch long").parquet(f"{base}/{x}").select("event_id") for x in ("kept", "aside"))
    return kept.withColumn("invalid", F.lit(False)).union(aside.withColumn("invalid", F.lit(True)))


@query("stream_silent_users", """
SELECT user_id, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY user_id
HAVING epoch_us(max(ts)) // 1000 + 86400000 <= (SELECT epoch_us(max(ts)) // 1000 - 5000 FROM events)""")
def stream_silent_users(spark, d):
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        return streaming.drain(streaming.silent_keys(_events(spark, d), "user_id", "t", 86400))
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query("stream_features", """
SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id
HAVING max(ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events)""")
def stream_features(spark, d):
    path = streaming.shared_folder(spark, "features")
    stream = _events(spark, d).select("user_id", "event_id", "event_type", "value", "t")
    sink = stores.feature_sink(f"{path}/rows", "user_id", "t", 86400)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    now = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return stores.latest_features(spark, f"{path}/rows", "user_id", ["t", "event_id"], now).select("user_id", "value", "event_type")


@query("dimension_refresh", "SELECT c_custkey, upper(n_name) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dimension_refresh(spark, d):
    path = streaming.shared_folder(spark, "dimension")
    nation = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("nation"))
    stores.publish_dimension(nation, path, 1)
    stores.publish_dimension(nation.withColumn("nation", F.upper("nation")), path, 2)
    customers = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return joins.lookup_join(customers, stores.latest_dimension(spark, path), ["n_nationkey"]).select("c_custkey", "nation")


@query("stream_progress", "SELECT count(*)::BIGINT AS rows FROM events")
def stream_progress(spark, d):
    out, state = streaming.shared_folder(spark, "progress"), streaming.shared_folder(spark, "progress-state")
    query_ = _events(spark, d).select("event_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query_.awaitTermination()
    return stores.progress(spark, query_).agg(F.sum("rows").alias("rows"))


@query("stream_sql_source", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def stream_sql_source(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    spark.sql("DROP TABLE IF EXISTS tessera_stream_source")
    spark.sql(f"CREATE TABLE tessera_stream_source USING parquet LOCATION '{streaming.shared_folder(spark, 'source')}/t' AS SELECT n_nationkey, n_regionkey FROM nation")
    counts = spark.readStream.table("tessera_stream_source").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return streaming.drain(counts, "complete")


@query("arrow_files", "SELECT event_id, user_id, event_type, value FROM events")
def arrow_files(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return sources.from_arrow_ipc(sources.to_arrow_ipc(rows), "event_id long, user_id long, event_type string, value double")


@query("csv_rejects", "SELECT n_nationkey::BIGINT AS key, n_nationkey % 5 = 0 AS rejected FROM nation")
def csv_rejects(spark, d):
    path = streaming.shared_folder(spark, "lines")
    key = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("x"), key, F.lit(",oops,1,2"))).otherwise(F.concat_ws(",", key, "n_name"))
    table(spark, d, "nation").select(line.alias("value")).write.text(path)
    good, bad = sources.read_csv_with_rejects(spark, path, "key long, name string", header=False)
    return good.select("key", F.lit(False).alias("rejected")).union(bad.select(F.regexp_extract("line", "^x([0-9]+)", 1).cast("long"), F.lit(True)))


@query("registry_frames", "SELECT n_nationkey::INT AS schema_id, n_name AS payload FROM nation")
def registry_frames(spark, d):
    framed = F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex("n_nationkey"), 8, "0")), F.encode("n_name", "utf-8"))
    out = sources.registry_frames(table(spark, d, "nation").select(framed.alias("value")))
    return out.select("schema_id", F.decode("payload", "utf-8").alias("payload"))


@query("sequence_values", "SELECT c_custkey, (1000 + 5 * (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1))::BIGINT AS next_value FROM customer")
def sequence_values(spark, d):
    placed = joins.row_positions(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), "c_custkey"], "pos")
    return placed.select("c_custkey", (1000 + 5 * F.col("pos")).alias("next_value"))


@query("sql_session_variable", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def sql_session_variable(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    spark.sql("DECLARE OR REPLACE VARIABLE tessera_least DOUBLE DEFAULT 0")
    spark.sql("SET VAR tessera_least = 150000")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > session.tessera_least")


sql("sql_clock", "SELECT r_regionkey, current_timestamp() >= TIMESTAMP '2020-01-01' AS started, current_date() = CAST(now() AS DATE) AS today FROM region",
    "SELECT r_regionkey, now() >= TIMESTAMPTZ '2020-01-01 00:00:00+00' AS started, current_date = CAST(now() AS DATE) AS today FROM region")


@query("constant_and_checked", "SELECT event_id, CASE WHEN nullif(event_type, 'click') IS NOT NULL THEN 1 END AS c, round(value, 6) AS v FROM events")
def constant_and_checked(spark, d):
    kind = F.nullif("event_type", F.lit("click"))
    value = scalars.checked(F.round("value", 6), F.col("value") >= 0, "a value is negative")
    return table(spark, d, "events").select("event_id", scalars.constant_or_null(1, kind).alias("c"), value.alias("v"))
