"""Every query of the engine with SQL gives what DuckDB gives for that SQL, over whole tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from framefold import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    told = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(names)
    rows = plain(told.fetchall(), names)
    assert rows and plain(found.collect(), found.columns) == rows


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 640


def test_every_frame_is_processed(spark):
    frames = {(r.stack, r.img) for r in queries.frames(spark, DATA).select("stack", "img").collect()}
    for name in ("ecc_translation", "registration_ladder"):
        assert {(r.stack, r.img) for r in queries.QUERIES[name](spark, DATA).select("stack", "img").collect()} == frames, name
    assert {r.stack for r in queries.QUERIES["pyramid_stack"](spark, DATA).select("stack").collect()} == {s for s, _ in frames}


@pytest.mark.parametrize("name", ["ecc_translation", "corner_features", "registration_ladder"])
def test_frames_of_one_file_are_worked_on_in_many_tasks(spark, name):
    assert queries.QUERIES[name](spark, DATA).select(F.spark_partition_id()).distinct().count() > 1
