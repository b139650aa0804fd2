"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from arborel.plans.oracles import ORACLES
from arborel.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return con


def rows(table, columns):
    return Counter(zip(*[table[c].to_pylist() for c in columns], strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
