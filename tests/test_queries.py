"""Each query against its SQL on another engine."""

import os

import duckdb
import pytest

import __spark_entry__
from folioflow.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    columns = sorted(got.column_names)
    if name not in SQL:
        assert got.num_rows
        return
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[k] for k in at)) for r in cursor.fetchall())
    assert sorted(map(repr, zip(*(got[c].to_pylist() for c in columns), strict=True))) == want


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 4
