"""Every registered query against its SQL on the same data."""

import pytest

from tillbook.plans import registry
from tillbook.plans.compare import compare

QUERIES = registry.queries()
ORACLES = registry.oracles()


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name in ORACLES:
        assert compare(frame, ORACLES[name], sf_dir) is None
    else:
        assert frame.count() > 0
