"""Every query with SQL, against DuckDB on the same tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from marlstone.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    q = con.sql(registry.ORACLE[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
