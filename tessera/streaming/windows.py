"""Structured Streaming: windows with watermarks, keyed state, deduplication, joins, late data and sinks.

Functions take and return streaming DataFrames; ``drain`` runs one to its end over what its source holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessera.operators import windows
from tessera.session import checkpoint_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A parquet file or folder as a stream; the schema is that of its files.

    The pattern in the last character lets one file be a source, which a plain path to a file can't be.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(df: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs the stream over all that its source holds and returns what it wrote, from shared storage.

    ``complete`` and ``update`` keep the last result: that of the last micro-batch, or of each row's last batch number.
    """
    spark, out, state = df.sparkSession, shared_folder(df.sparkSession, name), shared_folder(df.sparkSession, f"{name}-state")
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        def write(batch: DataFrame, n: int) -> None:
            # A batch that is run again overwrites its own folder: the sink stays exactly-once.
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(df.schema if mode == "append" else df.schema.add("batch", "long")).parquet(out)
    if mode == "complete":
        got = got.where(F.col("batch") == (got.agg(F.max("batch")).first()[0] or 0)).drop("batch")
    return got


def continuous_aggregate(df: DataFrame, on: str, size: str, aggs: dict[str, Column], by: Sequence[str] = (), watermark: str = "5 seconds", **kind) -> DataFrame:
    """Windows per key that are emitted once the watermark passes their end."""
    return windows.window_aggregate(df, on, size, aggs, by, watermark=watermark, **kind)


def deduplicate(df: DataFrame, keys: Sequence[str], on: str, within: str) -> DataFrame:
    """First row of each key; state is kept for ``within`` of event time."""
    return df.withWatermark(on, within).dropDuplicatesWithinWatermark(list(keys))


def interval_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], within: str, watermark: str = "1 hour") -> DataFrame:
    """Stream-stream join of equal keys whose times differ by at most ``within``; both sides' state expires by watermark."""
    a = left.withWatermark(on, watermark).select(*[F.col(c).alias(f"left_{c}") for c in left.columns])
    b = right.withWatermark(on, watermark).select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    match = F.expr(f"right_{on} BETWEEN left_{on} - INTERVAL {within} AND left_{on} + INTERVAL {within}")
    for k in by:
        match &= F.col(f"left_{k}") == F.col(f"right_{k}")
    return a.join(b, match)


class KeyedFold(StatefulProcessor):
    """Running count, sum, smallest and largest value of each key, and a mean weighted to new values (alpha)."""

    def __init__(self, value: str, key: str, alpha: float = 0.5):
        self.value, self.key, self.alpha = value, key, alpha

    def init(self, handle) -> None:
        self.state = handle.getValueState("fold", "n long, total double, low double, high double, mean double")

    def handleInputRows(self, key, rows, timers):
        n, total, low, high, mean = self.state.get() if self.state.exists() else (0, 0.0, float("inf"), float("-inf"), None)
        for pdf in rows:
            for v in pdf[self.value].tolist():
                n, total, low, high = n + 1, total + v, min(low, v), max(high, v)
                mean = v if mean is None else self.alpha * v + (1 - self.alpha) * mean
        self.state.update((n, total, low, high, mean))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "total": [total], "low": [low], "high": [high], "mean": [mean]})

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Emits a key with its last time once the watermark has passed that time by ``gap_ms``: an event-time timer for each key."""

    def __init__(self, key: str, on: str, gap_ms: int):
        self.key, self.on, self.gap_ms = key, on, gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(pdf[self.on].max().value // 1_000_000 for pdf in rows if len(pdf))
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.gap_ms)
        yield pd.DataFrame({self.key: [], "last_ms": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            yield pd.DataFrame({self.key: [key[0]], "last_ms": [self.last.get()[0]]})
            self.last.clear()

    def close(self) -> None:
        pass


def silent_keys(df: DataFrame, key: str, on: str, gap_seconds: int, watermark: str = "5 seconds") -> DataFrame:
    """``Silence`` over a stream, in append mode; the session must use the RocksDB state store."""
    kind = dict(df.dtypes)[key]
    rows = df.select(key, on).withWatermark(on, watermark)
    return rows.groupBy(key).transformWithStateInPandas(Silence(key, on, gap_seconds * 1000), f"`{key}` {kind}, last_ms long", "Append", "EventTime")


def keyed_fold(df: DataFrame, key: str, value: str, alpha: float = 0.5) -> DataFrame:
    """``KeyedFold`` over a stream, in update mode; the session must use the RocksDB state store."""
    kind = dict(df.dtypes)[key]
    return df.groupBy(key).transformWithStateInPandas(KeyedFold(value, key, alpha), f"`{key}` {kind}, n long, total double, low double, high double, mean double", "Update", "None")


def split_late(batch: DataFrame, on: str, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows on time and late ones, inside foreachBatch, against a watermark value."""
    late = F.coalesce(F.col(on) < F.lit(watermark), F.lit(False))
    return batch.where(~late), batch.where(late)


def with_dead_letters(process: Callable[[DataFrame, int], None], valid: Column, dead_letter_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sets the rows that aren't ``valid`` aside and processes the others.

    Failures of ``process`` itself stop the stream, so that it is retried from its checkpoint. A batch that runs again replaces what it set aside.
    """

    def run(batch: DataFrame, n: int) -> None:
        good = F.coalesce(valid, F.lit(False))
        batch.where(~good).write.mode("overwrite").parquet(f"{dead_letter_path}/batch={n}")
        process(batch.where(good), n)

    return run


def late_rows(df: DataFrame, on: str, delay: str, late_path: str, process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes rows older than the newest time of earlier batches less ``delay`` to ``late_path``.

    The newest time is kept beside them, so a restarted stream goes on from it; a batch that runs again finds the same value.
    """
    spark = df.sparkSession

    def run(batch: DataFrame, n: int) -> None:
        before = spark.read.schema("newest timestamp, batch long").parquet(f"{late_path}/newest").where(F.col("batch") < n).agg(F.max("newest")).first()[0] if n else None
        newest = batch.agg(F.max(F.col(on).cast("timestamp"))).first()[0]
        newest = max((x for x in (before, newest) if x is not None), default=None)
        spark.createDataFrame([(newest, n)], "newest timestamp, batch long").write.mode("overwrite").parquet(f"{late_path}/newest/part={n}")
        if before is None:
            process(batch, n)
            return
        on_time, late = split_late(batch, on, F.lit(before) - F.expr(f"interval {delay}"))
        late.write.mode("overwrite").parquet(f"{late_path}/rows/batch={n}")
        process(on_time, n)

    return run


def emit_new(found: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches that were not emitted before (incremental continuous queries)."""
    return found.join(seen.select(*keys).distinct(), list(keys), "left_anti")
