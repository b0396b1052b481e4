"""What streams keep beside their results: features that expire, versions of a dimension, and their own progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def feature_sink(path: str, entity: str, on: str, ttl_seconds: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores rows as features of an entity, which expire ``ttl_seconds`` after their time.

    Each batch has a folder of its own, which a batch that runs again replaces.
    """

    def run(batch: DataFrame, n: int) -> None:
        end = F.col(on).cast("timestamp") + F.make_interval(secs=F.lit(ttl_seconds))
        batch.withColumn("expires_at", end).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return run


def latest_features(spark: SparkSession, path: str, entity: str, order: Sequence[str], now) -> DataFrame:
    """The newest stored row of each entity that hasn't expired at ``now``."""
    rows = spark.read.parquet(path).drop("batch")
    rest = [c for c in rows.columns if c != entity]
    live = rows.where(F.col("expires_at") > F.lit(now)).groupBy(entity).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return live.select(entity, *[F.col(f"_r.`{c}`").alias(c) for c in rest if c != "expires_at"])


def publish_dimension(df: DataFrame, path: str, version: int) -> None:
    """Writes a version of a dimension; versions are numbered upwards, and readers see whole ones alone."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version, to join a stream's batches with; read again it follows later versions."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")


def progress(spark: SparkSession, query) -> DataFrame:
    """``batch, rows, rows_per_second, state_rows, duration_ms`` of a stream's recent batches."""
    rows = [(p["batchId"], int(p["numInputRows"]), float(p["processedRowsPerSecond"] or 0.0), sum(s["numRowsTotal"] for s in p["stateOperators"]),
             int(p["batchDuration"])) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, rows long, rows_per_second double, state_rows long, duration_ms long")
