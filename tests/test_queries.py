"""Every registered query against its SQL twin."""

import os

import pytest

from changelake.plans import REGISTRY
from changelake.plans.registry import execute
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_twin(spark, con, name):
    frame = execute(name, spark, SF_DIR)
    oracle.compare(frame, con, REGISTRY[name].sql)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "Python"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql])
def test_runs_without_twin(spark, name):
    assert execute(name, spark, SF_DIR).count() > 0
