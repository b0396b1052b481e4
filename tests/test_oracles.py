"""Every registered query of the library against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import registry

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 7)
    return v.isoformat() if hasattr(v, "isoformat") else v


def _rows(rows, columns, order):
    return sorted(tuple(str(_plain(r[columns.index(c)])) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    assert _rows(got, df.columns, order) == _rows(found.fetchall(), columns, order)
