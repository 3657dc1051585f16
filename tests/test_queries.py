"""Every registered query of the image engine against its SQL, at the smallest scale; plans that must not decay."""

import os

import pytest

from pixelloom.plans import registry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def database():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(name, spark, database):
    assert compare(spark, database, SF, registry.queries()[name], registry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def plan_of(spark, name: str) -> str:
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_decay(spark):
    """Exchanges, windows and Python where they are needed and no more."""
    plan = plan_of(spark, "q_filter_msad")
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Window [") <= 3 and "Python" not in plan and "Arrow" not in plan
    assert "Expand" not in plan
    plan = plan_of(spark, "q_adam7_order")
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    plan = plan_of(spark, "q_anim_roundtrip")
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("MapInArrow") == 2
    for name in ("q_idat_join", "q_segments"):
        assert "aggregate(" not in plan_of(spark, name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
