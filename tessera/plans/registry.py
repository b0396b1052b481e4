"""Collects the registered queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from tessera.plans import finance, graphs, relational, scalars, statements, streams, timeseries, upkeep

_GROUPS = (relational, timeseries, finance, graphs, scalars, streams, statements, upkeep)


def queries() -> dict:
    return {name: fn for group in _GROUPS for name, (fn, _) in group.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for group in _GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
