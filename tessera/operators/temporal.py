"""Bitemporal tables: rows with ``sys_from, sys_to`` (when recorded) and ``valid_from, valid_to`` (when true).

Open ends are null. Changes are unions and window recomputation over whole tables; nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _covers(start: str, end: str, at) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))


def as_of(df: DataFrame, system_time=None, valid_time=None, include_deleted: bool = False) -> DataFrame:
    """Rows recorded at ``system_time`` and true at ``valid_time``; either may be left out."""
    if system_time is not None:
        df = df.where(_covers("sys_from", "sys_to", system_time))
    if valid_time is not None:
        df = df.where(_covers("valid_from", "valid_to", valid_time))
    return df if include_deleted or "is_deleted" not in df.columns else df.where(~F.col("is_deleted"))


def between(df: DataFrame, low, high, axis: str = "sys") -> DataFrame:
    """Rows whose interval on an axis (``sys`` or ``valid``) overlaps [low, high)."""
    return df.where((F.col(f"{axis}_from") < F.lit(high)) & (F.col(f"{axis}_to").isNull() | (F.col(f"{axis}_to") > F.lit(low))))


def close_versions(df: DataFrame, keys: Sequence[str], start: str = "sys_from", end: str = "sys_to", tie: Sequence[str] = ()) -> DataFrame:
    """Each version ends where the key's next one starts."""
    return df.withColumn(end, F.lead(start).over(W.partitionBy(*keys).orderBy(start, *tie)))


def apply_changes(df: DataFrame, changes: DataFrame, keys: Sequence[str], at) -> DataFrame:
    """Appends new versions (``changes``: the value columns and ``is_deleted``) as of ``at``, closing those they replace."""
    at = F.lit(at)
    open_rows, old = df.where("sys_to IS NULL"), df.where("sys_to IS NOT NULL")
    replaced = open_rows.join(changes.select(*keys).distinct(), list(keys), "left_semi").withColumn("sys_to", at.cast(dict(df.dtypes)["sys_from"]))
    kept = open_rows.join(changes.select(*keys).distinct(), list(keys), "left_anti")
    fresh = changes.withColumn("sys_from", at.cast(dict(df.dtypes)["sys_from"])).withColumn("sys_to", F.lit(None).cast(dict(df.dtypes)["sys_from"]))
    return old.unionByName(replaced).unionByName(kept).unionByName(fresh, allowMissingColumns=True)


def history(df: DataFrame, **key) -> DataFrame:
    """All versions of a key, oldest first."""
    for c, v in key.items():
        df = df.where(F.col(c) == v)
    return df.orderBy("sys_from")


def expire(df: DataFrame, on: str, now, ttl_seconds: int) -> DataFrame:
    """Rows younger than the time to live."""
    return df.where(F.unix_seconds(F.col(on).cast("timestamp")) > F.unix_seconds(F.lit(now).cast("timestamp")) - ttl_seconds)


def delete_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows outside [low, high); null keys stay."""
    return df.where(~F.coalesce((F.col(column) >= low) & (F.col(column) < high), F.lit(False)))


def multi_get(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted keys."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
