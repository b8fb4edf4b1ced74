"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import os

import pytest

from auditlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 100_000 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted(tuple(map(plain, r)) for r in ours.select(*columns).collect())
    b = sorted(tuple(map(plain, r)) for r in theirs.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
