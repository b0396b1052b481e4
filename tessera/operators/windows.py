"""Time windows, resampling and window frames as DataFrame functions (batch and streaming where Spark allows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.operators.joins import row_positions
from tessera.session import cut


def window_aggregate(df: DataFrame, on: str, size: str, aggs: dict[str, Column], by: Sequence[str] = (), slide: str | None = None,
                     gap: str | None = None, watermark: str | None = None) -> DataFrame:
    """Tumbling, sliding (``slide``) or session (``gap``) windows per key: ``window_start, window_end`` and the aggregates.

    With ``watermark`` a streaming input emits a window once the watermark passes its end.
    """
    if slide and slide == size:
        slide = None
    df = df.withWatermark(on, watermark) if watermark else df
    win = F.session_window(on, gap) if gap else F.window(on, size, slide) if slide else F.window(on, size)
    out = df.groupBy(*by, win.alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggs)


#: Positions of a block whose running sum is taken at once.
SUM_BLOCK = 65_536


def _per_key(rows: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Rows with an aggregate of their key; nulls are a key too. The keys' aggregates are joined back, so a hot key stays spread."""
    keys = [f"_k{i}" for i in range(len(by))]
    each = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(value.alias(name))
    on = F.lit(True)
    for c, k in zip(by, keys):
        on = on & rows[c].eqNullSafe(each[k])
    return rows.join(each, on).drop(*keys)


def count_windows(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """``window`` numbers runs of ``n`` rows of each key in order, from 0.

    Rows are numbered in one order over all keys, dealt by ranges of it, so a hot key isn't gathered in one task.
    """
    rows = _per_key(row_positions(df, [*by, *order], "_pos"), by, F.min("_pos"), "_first")
    return rows.withColumn("window", F.floor((F.col("_pos") - F.col("_first")) / n).cast("long")).drop("_pos", "_first")


def session_numbers(df: DataFrame, on: str, by: Sequence[str], gap_seconds: float, tie: str) -> DataFrame:
    """``session`` numbers the sessions of each key from 1; a new one starts after a gap longer than ``gap_seconds``.

    Each row meets the one before it by its position in one order over all keys; the starts are summed block by block along that order.
    """
    t = F.unix_micros(F.col(on).cast("timestamp"))
    rows = cut(row_positions(df, [*by, on, tie], "_pos"))
    before = rows.select((F.col("_pos") + 1).alias("_pos"), t.alias("_t"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0)).alias("_key"))
    same = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0)) == F.col("_key")
    known = rows.join(before, "_pos", "left").withColumn("_new", F.when(same & (t - F.col("_t") <= gap_seconds * 1_000_000), 0).otherwise(1)).drop("_t", "_key")
    known = cut(known.withColumn("_b", F.floor(F.col("_pos") / SUM_BLOCK)))
    blocks = known.groupBy("_b").agg(F.sum("_new").alias("_n"))
    blocks = blocks.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))  # a row for each block
    inside = F.sum("_new").over(W.partitionBy("_b").orderBy("_pos"))
    summed = known.withColumn("_s", inside).join(blocks, "_b").withColumn("_s", F.col("_s") + F.col("_before"))
    out = _per_key(summed, by, F.min("_s"), "_first")
    return out.withColumn("session", F.col("_s") - F.col("_first") + 1).select(*df.columns, "session")


def latest_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; pre-aggregated, so a hot key is no bottleneck."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(df.columns)


def earliest_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The oldest row of each key."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(df.columns)


def sample_by(df: DataFrame, on: str, step: str, aggs: dict[str, Column], by: Sequence[str] = (), fill: str | None = None) -> DataFrame:
    """Resampling in steps: ``ts`` (the start of the step) and the aggregates per key.

    ``fill``: None leaves gaps, ``null`` adds the missing steps of each key's span, ``prev`` repeats the last values,
    ``linear`` interpolates.
    """
    got = window_aggregate(df, on, step, aggs, by).withColumnRenamed("window_start", "ts").drop("window_end")
    if fill is None:
        return got
    span = got.groupBy(*by).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    # In runs of a thousand steps, so no row holds a key's whole grid.
    runs = span.select(*by, "_b", F.explode(F.expr(f"sequence(_a, _b, 1000 * interval {step})")).alias("_a"))
    grid = runs.select(*by, F.explode(F.expr(f"sequence(_a, least(_b, _a + 999 * interval {step}), interval {step})")).alias("ts"))
    out = grid.join(got, [*by, "ts"], "left")
    if fill == "null":
        return out
    w = W.partitionBy(*by).orderBy("ts")
    if fill == "prev":
        return out.select(*by, "ts", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in aggs])
    if fill == "linear":
        return out.select(*by, "ts", *[interpolate(F.col(n), F.unix_micros(F.col("ts").cast("timestamp")), w).alias(n) for n in aggs])
    raise ValueError("fill is None, 'null', 'prev' or 'linear'")


def interpolate(value: Column, at: Column, w) -> Column:
    """Nulls by the line between the nearest values before and after; ends stay null."""
    known = F.when(value.isNotNull(), F.struct(at.cast("double").alias("t"), value.cast("double").alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(at.cast("double") - a["t"], b["t"] - a["t"])
    return F.coalesce(value.cast("double"), line)


def groups_frame(agg: Column, by: Sequence[str], order: Column, name: str, df: DataFrame, start: int, end: int) -> DataFrame:
    """``agg`` over a GROUPS frame: peers of the order count as one step."""
    rank = F.dense_rank().over(W.partitionBy(*by).orderBy(order))
    w = W.partitionBy(*by).orderBy("_g").rangeBetween(start, end)
    return df.withColumn("_g", rank.cast("long")).withColumn(name, agg.over(w)).drop("_g")


def sum_excluding(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str, exclude: str = "current row") -> DataFrame:
    """Running sum over the partition with the current row, its peer group, or its other peers (ties) left out."""
    v = F.coalesce(F.col(value), F.lit(0))
    whole = F.sum(v).over(W.partitionBy(*by))
    peers = F.sum(v).over(W.partitionBy(*by, *order))
    out = {"current row": whole - v, "group": whole - peers, "ties": whole - peers + v}[exclude]
    return df.withColumn(name, out)
