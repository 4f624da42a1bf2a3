"""Queries against their SQL on another engine."""

import duckdb
import pytest

from folioflow.llm.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = queries()[name](spark, DATA).toArrow()
    assert sorted(got.column_names) == sorted(columns)
    assert sorted(zip(*(got[c].to_pylist() for c in columns), strict=True)) == sorted(cursor.fetchall())
