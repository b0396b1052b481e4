"""Joins that Spark has no operator for: as-of, interval, window, versioned, inequality and positional.

All are compositions of DataFrame operations. Keys may be skewed: the as-of join deals a key's rows to
time buckets and carries the last value between buckets, and the inequality join to bins, so no key is gathered
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.session import cut


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), tolerance: float | None = None,
              direction: str = "backward", tie: str | None = None, bucket: float | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the right row of the nearest time at or before it (``forward``: at or after it).

    Left rows always stay; times further than ``tolerance`` (in units of ``on``, seconds for timestamps) give nulls; bounds
    are inclusive. Of right rows with equal times the one of the smallest ``tie`` wins backward, the largest forward.
    ``bucket`` (same units) spreads each key over time buckets; by default as many buckets as there are shuffle partitions cover the right side's span,
    and 0 leaves each key in one task. Right columns get ``prefix``; ``by`` columns come once.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    forward, by = direction == "forward", list(by)
    is_time = dict(left.dtypes)[on].startswith(("timestamp", "date"))
    number = (lambda c: _seconds(F.col(c))) if is_time else (lambda c: F.col(c).cast("double"))
    if bucket is None:
        span = right.select(number(on).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
        bucket = (span["b"] - span["a"]) / int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) if span["a"] is not None else 0
    values = [c for c in right.columns if c not in by]
    packed = F.struct(*values)
    kept = F.struct(*left.columns)
    rows = left.select(*by, number(on).alias("_t"), F.lit(None).cast(right.select(packed).dtypes[0][1]).alias("_r"),
                       F.lit(None).cast(dict(right.dtypes)[tie] if tie else "int").alias("_tie"), kept.alias("_l"))
    theirs = right.select(*by, number(on).alias("_t"), packed.alias("_r"),
                          (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"), F.lit(None).cast(left.select(kept).dtypes[0][1]).alias("_l"))
    both = rows.unionByName(theirs.where("_t IS NOT NULL"))
    group = [*by]
    if bucket:
        both = both.withColumn("_b", F.floor(F.col("_t") / bucket).cast("long"))
        group.append("_b")
    # Right rows come before the left rows of their time, and the winner of a tie last among its equals.
    order = [F.col("_t").desc() if forward else F.col("_t").asc(), F.col("_l").isNotNull().asc(),
             F.col("_tie").asc_nulls_first() if forward else F.col("_tie").desc_nulls_first()]
    seen = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_r").isNotNull(), F.struct("_r", "_t")), ignorenulls=True)
    both = both.withColumn("_m", hit.over(seen))
    if bucket:
        # The last match of each bucket, carried on; one row per key and bucket.
        known = both.where("_r IS NOT NULL")
        ends = known.groupBy(*group).agg((F.min if forward else F.max)("_t").alias("_t"))
        pick = (F.max_by if forward else F.min_by)(F.struct("_r", "_t"), F.col("_tie")) if tie else F.any_value(F.struct("_r", "_t"))
        ends = known.select(*group, "_t", "_tie", "_r").join(ends, [*group, "_t"]).groupBy(*group).agg(pick.alias("_e"))
        spans = both.select(*group).distinct().join(ends, group, "left")
        run = W.partitionBy(*by).orderBy(F.col("_b").desc() if forward else F.col("_b").asc()).rowsBetween(W.unboundedPreceding, -1)
        carry = spans.withColumn("_c", F.last("_e", ignorenulls=True).over(run)).select(*group, "_c")
        both = both.where("_l IS NOT NULL").join(carry, group, "left").withColumn("_m", F.coalesce("_m", "_c"))
    out = both.where("_l IS NOT NULL")
    gap = F.abs(F.col("_t") - F.col("_m._t"))
    match = F.when(gap <= tolerance, F.col("_m._r")) if tolerance is not None else F.col("_m._r")
    out = out.withColumn("_m", match)
    return out.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *[F.col(f"_m.`{c}`").alias(f"{prefix}{c}") for c in values])


def temporal_join(stream: DataFrame, versions: DataFrame, on: str, by: Sequence[str], how: str = "inner", tie: str | None = None, bucket: float | None = None) -> DataFrame:
    """Each row with the newest version at or before its time; version columns get ``table_``. ``how``: inner or left."""
    out = asof_join(stream, versions, on, by, tie=tie, bucket=bucket, prefix="table_")
    return out.where(F.col(f"table_{on}").isNotNull()) if how == "inner" else out


def interval_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], within: float, how: str = "inner") -> DataFrame:
    """Rows of equal keys whose times differ by at most ``within``; columns get ``left_`` and ``right_``.

    The time range becomes an equality on buckets of twice the width, so the join is dealt by key and bucket, and
    a hot key is spread over its time span.
    """
    number = (lambda c: _seconds(F.col(c))) if dict(left.dtypes)[on].startswith(("timestamp", "date")) else (lambda c: F.col(c).cast("double"))
    width = 2 * within or 1
    a = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns], number(on).alias("_lt"), F.floor(number(on) / width).alias("_b"))
    t = number(on)
    near = F.array_distinct(F.array(F.floor((t - within) / width), F.floor((t + within) / width)))
    b = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns], t.alias("_rt"), F.explode(near).alias("_rb"))
    match = F.col("_b") == F.col("_rb")
    for k in by:
        match &= F.col(f"left_{k}") == F.col(f"right_{k}")
    match &= F.abs(F.col("_lt") - F.col("_rt")) <= within
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'; swap the sides for 'right'")
    return a.join(b, match, how).drop("_lt", "_rt", "_b", "_rb")


def window_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], size: str) -> DataFrame:
    """Rows of equal keys in the same tumbling window; columns get ``left_`` and ``right_``."""
    a = left.select(F.window(F.col(on), size).getField("start").alias("window_start"), *[F.col(c).alias(f"left_{c}") for c in left.columns])
    b = right.select(F.window(F.col(on), size).getField("start").alias("window_start"), *[F.col(c).alias(f"right_{c}") for c in right.columns])
    b = b.withColumnsRenamed({f"right_{k}": f"left_{k}" for k in by})
    return a.join(b, ["window_start", *[f"left_{k}" for k in by]])


#: Pairs that one group of a range join compares on average at most.
RANGE_PAIRS = 32_000_000


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= value <= high``: values and ranges meet in bins of ``width`` (two inequalities as an equality).

    The points of a bin with more than ``RANGE_PAIRS`` pairs are dealt into parts, each of which meets all of the bin's ranges. There are as many
    tasks as the pairs call for, since the inputs are small beside the pairs.
    """
    a = points.withColumn("_bin", F.floor(F.col(value) / width))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    sizes = a.groupBy("_bin").agg(F.count("*").alias("_n")).join(b.groupBy("_bin").agg(F.count("*").alias("_m")), "_bin")
    work = F.col("_n").cast("double") * F.col("_m")
    sizes = cut(sizes.select("_bin", F.least(F.ceil(work / RANGE_PAIRS), "_n").alias("_k"), work.alias("_w")))
    pairs = sizes.agg(F.sum("_w")).first()[0] or 0.0
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(2 * pairs / RANGE_PAIRS))
    sizes, keys = sizes.drop("_w"), ["_bin", "_part"]
    a = a.join(sizes, "_bin").withColumn("_part", F.floor(F.rand(7) * F.col("_k"))).drop("_k").repartition(tasks, *keys)
    b = b.join(sizes, "_bin").withColumn("_part", F.explode(F.expr("sequence(0L, _k - 1)"))).drop("_k").repartition(tasks, *keys)
    return a.join(b.hint("merge"), keys).where(F.col(value).between(F.col(low), F.col(high))).drop(*keys)


def row_positions(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """0-based position of each row in the order, without one task seeing all rows.

    Rows are range-partitioned; the sizes of partitions, a few numbers for each, are summed on the driver.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))  # numbered once
    counts = sorted((r["_p"], r["n"], r["f"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("f")).collect())
    start, rows = 0, []
    for p, n, first in counts:
        rows.append((p, start - first))
        start += n
    shift = spark.createDataFrame(rows, "_p int, _shift long")
    return placed.join(F.broadcast(shift), "_p").withColumn(name, F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift")


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Rank of each row in the order of the whole table (equal rows share one, then a gap), without one task seeing all rows.

    Equal rows meet in one range of the order; what stands before a range is summed on the driver from the sizes of ranges.
    """
    spark = df.sparkSession
    placed = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id()))
    start, rows = 0, []
    for r in placed.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        rows.append((r["_p"], start))
        start += r["n"]
    before = spark.createDataFrame(rows, "_p int, _before long")
    rank = F.rank().over(W.partitionBy("_p").orderBy(*order)).cast("long")
    return placed.withColumn(name, rank).join(F.broadcast(before), "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence, right_order: Sequence) -> DataFrame:
    """Rows side by side by their position in the orders; the shorter side is padded with nulls."""
    a, b = row_positions(left, left_order, "_pos"), row_positions(right, right_order, "_pos")
    return a.join(b, "_pos", "full").drop("_pos")


def lookup_join(rows: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Enrichment by a dimension; Spark broadcasts it when its size is below the session's threshold and shuffles else."""
    return rows.join(dimension, list(on), how)
