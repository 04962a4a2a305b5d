"""Every registered query against its SQL on the smallest tables, and plan shapes."""

import pytest

import compare
import workload
import __spark_entry__ as entry_point

workload.load()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    status, _, _, _, detail = compare.compare(spark, connection, SMALL, name)
    assert status in ("ok", "rows-only"), detail or status


def test_entry(spark):
    rows = {r.check: r.state for r in entry_point.entry(spark).collect()}
    assert rows["sentinel_scan"] == "FAIL" and rows["dec_check"] == "PASS"


@pytest.mark.parametrize("name", [
    "name_filter_fuzzy", "rule_join", "column_presence", "manifest_compare", "version_check",
    "rollup_author", "guess_ucd", "ucd_validate", "report_filter"])
def test_plans_hold_no_pairwise_joins(spark, name):
    plan = workload.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_scans_once_and_prunes_columns(spark):
    plan = workload.QUERIES["range_both"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_totalprice:double>" in plan
