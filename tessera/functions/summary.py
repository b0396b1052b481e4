"""Column summaries, samples and clusters of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, n, nulls, low, high, mean`` of numeric columns: one aggregation, whatever their number."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats.append(F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("low"),
                              F.max(x).alias("high"), F.avg(x).alias("mean")))
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with the same chance; no shuffle."""
    return df.sample(fraction, seed)


def reservoir_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): each task keeps its ``n`` first by a random number, then they merge."""
    return df.orderBy(F.rand(seed)).limit(n)


def kmeans(df: DataFrame, k: int, vector: str = "embedding", name: str = "cluster", seed: int = 0) -> DataFrame:
    """``df`` with each row's cluster. Null vectors, and those with a null component, get null."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = df.where(whole).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name).fit(rows)
    rest = df.where(~F.coalesce(whole, F.lit(False))).withColumn(name, F.lit(None).cast("int"))
    return model.transform(rows).drop("_v").unionByName(rest)
