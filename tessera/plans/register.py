"""Registration of queries: a name, a function of (spark, sf_dir) and DuckDB SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.session import TABLES, table


class Group(dict):
    """name -> (function, oracle SQL or None)."""

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self[name] = (fn, sql)
            return fn

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in Spark SQL over the tables; the oracle is the same text unless given."""
        self[name] = ((lambda spark, d: run_sql(spark, d, text)), text if oracle is None else oracle)


def run_sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Spark SQL over the tables that the text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(text)
