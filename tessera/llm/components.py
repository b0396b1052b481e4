"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tessera.llm.common import discard, materialise


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges written to shared storage, and their number and checksum, observed as they are written."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"))
    out = materialise(counted, "cc")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Minima are pre-aggregated and joined back, so a hub's edges are never gathered in one task. Each round is
    written to shared storage, where it replaces the one before; only a count and a checksum reach the driver.
    """
    edges, state = _stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, (edges, now) = edges, _stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        if now == state:
            break
        state = now
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    hubs = edges.select(F.col("v").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.union(hubs.select("node", F.col("node").alias("component")))
