"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def _names():
    from sagalog.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _rows(df, columns):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    found = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = sorted(tuple("~" if v is None else str(v) for v in (r[found.columns.index(c)] for c in columns)) for r in found.fetchall())
    assert _rows(df, columns) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
