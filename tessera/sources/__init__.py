"""Sources and sinks by format or address, with projection and filters that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import cut

_SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text", ".avro": "avro"}


def _format(path: str) -> str:
    for suffix, fmt in _SUFFIXES.items():
        if path.rstrip("/").endswith(suffix):
            return fmt
    return "parquet"


def read(spark: SparkSession, uri: str, columns: Sequence[str] | None = None, where: Column | str | None = None, schema=None, **options) -> DataFrame:
    """A DataFrame from a path or address: files by suffix, ``jdbc:``, ``postgresql://``, ``delta://``, ``table://``.

    Unknown schemes raise ValueError; formats whose driver isn't on the class path raise what Spark raises.
    """
    scheme = urlparse(uri).scheme
    if uri.startswith("jdbc:"):
        df = spark.read.format("jdbc").options(url=uri, **options).load()
    elif scheme in ("postgresql", "postgres"):
        df = spark.read.format("jdbc").options(url=f"jdbc:postgresql://{uri.split('://', 1)[1]}", **options).load()
    elif scheme == "delta":
        df = spark.read.format("delta").options(**options).load(uri.split("://", 1)[1])
    elif scheme == "table":
        df = spark.table(uri.split("://", 1)[1])
    elif scheme in ("", "file", "s3", "s3a", "hdfs", "gs", "abfss", "http", "https", "viewfs"):
        fmt = _format(uri)
        if fmt == "csv":
            options = {"header": True, "sep": "\t" if uri.endswith(".tsv") else ",", **({} if schema else {"inferSchema": True}), **options}
        reader = spark.read.format(fmt).options(**options)
        df = (reader.schema(schema) if schema else reader).load(uri)
    else:
        raise ValueError(f"no source for {scheme}:")
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def write(df: DataFrame, uri: str, mode: str = "error", partition_by: Sequence[str] = (), **options) -> None:
    """The counterpart of ``read``."""
    scheme = urlparse(uri).scheme
    writer = df.write.mode(mode).options(**options)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if uri.startswith("jdbc:"):
        writer.format("jdbc").option("url", uri).save()
    elif scheme == "delta":
        writer.format("delta").save(uri.split("://", 1)[1])
    elif scheme == "table":
        writer.saveAsTable(uri.split("://", 1)[1])
    elif scheme in ("", "file", "s3", "s3a", "hdfs", "gs", "abfss", "viewfs"):
        fmt = _format(uri)
        (writer.option("header", options.get("header", True)) if fmt == "csv" else writer).format(fmt).save(uri)
    else:
        raise ValueError(f"no sink for {scheme}:")


def read_csv_with_rejects(spark: SparkSession, path: str, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and those that don't: the whole ``line`` beside what could be parsed of it. The files are parsed once, for both."""
    rows = spark.read.options(**{"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", **options}).schema(f"{schema}, _bad string").csv(path)
    rows = cut(rows)
    good = rows.where("_bad IS NULL").drop("_bad")
    return good, rows.where("_bad IS NOT NULL").withColumnRenamed("_bad", "line")


def dates_from_text(df: DataFrame) -> DataFrame:
    """Text columns whose names hold ``date`` become dates; what doesn't parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast("date") for c, kind in df.dtypes if kind == "string" and "date" in c.lower()})


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str | None = None, **options) -> DataFrame:
    """A topic as a stream of its records, or of the JSON fields of their values. Needs Spark's Kafka package."""
    rows = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    if schema is None:
        return rows
    return rows.select(F.col("timestamp").alias("_ts"), F.from_json(F.col("value").cast("string"), schema).alias("v")).select("_ts", "v.*")


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    """Starts a query that writes rows as JSON values, keyed (and so partitioned) by a column."""
    rows = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}).start()


def registry_frames(df: DataFrame, value: str = "value") -> DataFrame:
    """Kafka values in the framing of a schema registry: adds ``schema_id`` and ``payload``; other values give nulls."""
    v = F.col(value)
    framed = (F.octet_length(v) >= 5) & (F.substring(v, 1, 1) == F.lit(b"\0"))
    number = F.conv(F.hex(F.substring(v, 2, 4)), 16, 10).cast("int")
    return df.withColumn("schema_id", F.when(framed, number)).withColumn("payload", F.when(framed, F.expr(f"substring(`{value}`, 6)")))


def decode_avro(df: DataFrame, column: str, schemas: dict[int, str], out: str = "v") -> DataFrame:
    """Framed Avro payloads decoded by the schema of their id (JSON text for each); rows of other ids give null. All schemas
    must have one result type. Needs Spark's Avro package."""
    from pyspark.sql.avro.functions import from_avro

    decoded = F.lit(None)
    rows = registry_frames(df, column)
    for number, schema in schemas.items():
        decoded = F.when(F.col("schema_id") == number, from_avro("payload", schema)).otherwise(decoded)
    return rows.withColumn(out, decoded).drop("schema_id", "payload")


def decode_protobuf(df: DataFrame, column: str, message: str, descriptor: bytes, out: str = "v") -> DataFrame:
    """Protobuf values decoded by a message of a descriptor set. Needs Spark's Protobuf package."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return df.withColumn(out, from_protobuf(column, message, binaryDescriptorSet=descriptor))


def to_arrow_ipc(df: DataFrame) -> DataFrame:
    """Rows as Arrow IPC streams: ``content binary``, one for each batch of a task."""

    def run(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")


def from_arrow_ipc(df: DataFrame, schema: str) -> DataFrame:
    """The rows of Arrow IPC files or streams in ``content``; columns are taken by name."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                buffer = data.as_buffer()
                reader = pa.ipc.open_file(buffer) if buffer[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(buffer)
                parts = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader
                for part in parts:
                    yield part.select(names)

    return df.select("content").mapInArrow(run, schema)


def read_arrow_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC files (or streams) below a path; each file is read whole by one task."""
    return from_arrow_ipc(spark.read.format("binaryFile").load(path), schema)


def merge_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """A table after change events: of each key the newest change wins; ``op`` 'd' deletes, others insert or update."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    last = last.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "d").select(target.columns))


def route_changes(changes: DataFrame, database: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Change events of the tables that match patterns with ``*``."""
    like = lambda p: "^" + p.replace(".", r"\.").replace("*", ".*") + "$"
    out = changes.where(F.col("database").rlike(like(database)) & F.col("table").rlike(like(table)))
    return out.select(*columns) if columns else out
