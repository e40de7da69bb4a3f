"""Every registered query against its DuckDB statement on the small tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, folder, name):
    frame = QUERIES[name](spark, folder)
    got = frame.toPandas()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in STATEMENTS:
        assert len(got)
        return
    assert differences(got, duck.execute(STATEMENTS[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_path", "query_idx", "rank", "doc_summary", "score"]


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
