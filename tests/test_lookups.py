"""Lookups of grants read a clustered table, and their filters reach its scan."""

import pytest

from wardstone.plans import registry


@pytest.mark.parametrize("key, pushed", [("S10_grant_by_id", "capability_grant_id"), ("S11_unrevoked_grant", "workspace_id"), ("K5_grants_page", "workspace_id")])
def test_filters_reach_the_scan(spark, sf, key, pushed):
    plan = registry.QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert f"({pushed}," in line.split("PushedFilters")[1] and "Window [row_number() windowspecdefinition(l_orderkey" not in plan


def test_the_table_is_written_once(spark, sf):
    first, again = (registry.QUERIES["S10_grant_by_id"](spark, sf).inputFiles() for _ in range(2))
    assert first == again
