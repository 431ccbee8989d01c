"""Every query with SQL against DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in got.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
