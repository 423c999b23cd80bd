"""Queries of conditions and kinds in path names, against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["prj11_condition_of", "prj12_kind_of"])
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{os.path.join(DATA, 'pages.parquet')}'")
    expected = con.execute(entry.oracle_sql()[name]).fetchall()
    made = [tuple(r) for r in entry.queries()[name](spark, DATA).collect()]
    assert len(expected) > 10 and sorted(made) == sorted(expected)
