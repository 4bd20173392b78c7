"""Every registered query of the graph engine against its DuckDB text, on whole tables."""

import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from flowlake.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        out.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return out


def plain(rows, order):
    value = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None else None
    return sorted((tuple(str(value(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    want = plain(found.fetchall(), [columns.index(c) for c in names])
    have = plain(rows, [df.columns.index(c) for c in names])
    assert have == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
