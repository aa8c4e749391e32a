"""Every registered query against its SQL, and the entry point."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as registry  # noqa: E402
from check import compare  # noqa: E402

FOLDER = os.environ.get("EMBERLOG_TESTDATA", "/root/testdata/sf0.001")
# Queries of the training-data package say themselves whether they have SQL; every other one needs it.
CORE = set(registry.QUERIES)


def test_registry_is_consistent():
    assert CORE <= set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.columns == ["panel", "key", "metric", "value"] and frame.count() > 0


def no_pairwise_join(frame):
    """Core queries never join pairwise."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    verdict, _, mine, other = compare(spark, FOLDER, name, no_pairwise_join)
    assert verdict in ("ok", "rows"), (mine[:3], other[:3])
    assert verdict == ("ok" if name in registry.oracle_sql() else "rows")
