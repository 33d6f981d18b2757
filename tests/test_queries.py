from __future__ import annotations

import pytest

import verify
from weftgraph.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    assert name in ORACLE
    assert verify.compare(spark, con, name, SF) == ""


def test_plans(spark):
    """Filters reach the scan, only the columns in use are read, and top-k never sorts everything."""
    plan = QUERIES["find_tiered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = QUERIES["cosine_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan and "BatchEvalPython" not in plan
    plan = QUERIES["prefix_compose"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
