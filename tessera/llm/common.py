"""Helpers shared by the corpus operators: shared storage, bounded Arrow batches, materialised cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one text column that a task handles at once; longer single values are still whole.
SLICE_BYTES = 4 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a local session (tests, one machine) uses a temporary folder; on a cluster, whose
    machines wouldn't share it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to shared storage and reads it back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of ``materialise`` results that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def without(df: DataFrame, name: str) -> list[str]:
    """Columns of ``df`` but for one that differs from ``name`` at most in case: the one a new column replaces."""
    return [c for c in df.columns if c.lower() != name.lower()]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most ``max_bytes`` of ``column`` (one row at least)."""
    n = batch.num_rows
    size = batch.column(column).nbytes
    if size <= max_bytes or n <= 1:
        if n:
            yield batch
        return
    half = n // 2
    yield from slices(batch.slice(0, half), column, max_bytes)
    yield from slices(batch.slice(half), column, max_bytes)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, column: str,
              max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``fn`` turns one slice into one record batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
