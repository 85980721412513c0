"""Every named query against its SQL twin on the smallest data set; queries without a twin must give rows.

No plan may hold a nested-loop join or a product.
"""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, connect, plan_of

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name in ORACLES:
        ok, message = compare(df, con, ORACLES[name])
        assert ok, message
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.query_id for r in rows} == {"q0", "q1", "q2", "q3", "q4"}
