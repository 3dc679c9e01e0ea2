"""The queries of this subpackage that have SQL, against it."""

import duckdb
import pytest

from bindings.compare import compare
from stockflow.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(ORACLES))
def test_query(spark, key):
    duck = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "conversations"):
        duck.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    frame = QUERIES[key](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    relation = duck.execute(ORACLES[key])
    types = [(d[0], str(d[1])) for d in relation.description]
    assert compare(frame.dtypes, [tuple(r) for r in frame.collect()], types, relation.fetchall()) is None
