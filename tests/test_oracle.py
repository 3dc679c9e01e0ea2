"""Every registered query against its SQL, and its plan against shapes that do not scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from bindings.compare import compare
from bindings.registry import oracle_queries, spark_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = spark_queries(), oracle_queries()
# rows that only larger data gives
MAY_BE_EMPTY = {"single_source_check"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, duck, key):
    frame = QUERIES[key](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    rows = [tuple(r) for r in frame.collect()]
    if key not in ORACLES:
        assert rows
        return
    relation = duck.execute(ORACLES[key])
    types = [(d[0], str(d[1])) for d in relation.description]
    problem = compare(frame.dtypes, rows, types, relation.fetchall())
    assert problem is None or (problem == "EMPTY" and key in MAY_BE_EMPTY), problem


def test_newest_rows_are_cut_before_the_shuffle(spark):
    for key in ("ingest_upsert", "latest_version", "shipment_position", "supplier_rank"):
        plan = QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, key


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["active_only"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
