"""The corpus queries that SQL can express give what DuckDB gives, over whole tables."""

import glob
import os

import duckdb
import pytest

from framefold.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = queries.QUERIES[name](spark, DATA)
    told = con.execute(queries.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(told.fetchall(), key=repr)
