"""Registered linkage queries against their SQL, on the smallest tables where those are there."""

import math
import os

import duckdb
import pytest

from kindred.plans import catalog

SF = "/root/testdata/sf0.001"


def _rows(frame, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert _rows(want, columns) == _rows(got, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_without_sql_runs(spark, name):
    catalog.QUERIES[name](spark, SF).collect()


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.FLAGSHIP in __spark_entry__.queries()
