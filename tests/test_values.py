import math

import pytest
from pyspark.sql import functions as F

from tablegate.operators import profile, reconcile, values
from tablegate.operators.values import RangeRule
from tablegate.sources import tables

NAN = float("nan")


def in_range(spark, rows, ddl, rule):
    return values.range_check(spark.createDataFrame(rows, ddl), [rule]).first()


@pytest.mark.parametrize("closed,low,high", [
    ("left", True, False), ("right", False, True), ("both", True, True), ("none", False, False)])
def test_closures_at_the_bounds(spark, closed, low, high):
    assert in_range(spark, [(1.0,)], "v double", RangeRule("v", 1, 5, closed)).in_range is low
    assert in_range(spark, [(5.0,)], "v double", RangeRule("v", 1, 5, closed)).in_range is high


def test_nulls_empty_tables_and_nan(spark):
    rule = RangeRule("v", 0, 1)
    assert in_range(spark, [], "v double", rule).in_range
    assert in_range(spark, [(None,)], "v double", rule).in_range
    row = in_range(spark, [(0.5,), (None,), (NAN,), (math.inf,), (-math.inf,)], "v double", rule)
    assert (row.in_range, row.violations) == (False, 3)


def test_bounds_take_the_type_of_the_column(spark):
    assert in_range(spark, [(0.1,)], "v float", RangeRule("v", 0.1, 0.1)).in_range
    big = 2 ** 53 + 1
    assert not in_range(spark, [(big,)], "v bigint", RangeRule("v", 0, big - 1)).in_range
    assert not in_range(spark, [(2,)], "v int", RangeRule("v", 0, 1.5)).in_range


def test_ranges_on_other_columns_fail_without_an_error(spark):
    assert not in_range(spark, [("7",)], "v string", RangeRule("v", 0, 9)).in_range
    assert not in_range(spark, [("7",)], "v string", RangeRule("w", 0, 9)).in_range


def test_profile_agrees_with_the_direct_check(spark):
    rows = [(0.1, 5, NAN), (0.25, 2 ** 53 + 1, 1.0), (None, None, None)]
    df = spark.createDataFrame(rows, "f float, i bigint, n double")
    profiles = profile.profile_table(df, "t")
    fields = spark.createDataFrame(
        [("t", "f", "float32", "0.1", "0.25"), ("t", "i", "int64", "5", str(2 ** 53)),
         ("t", "n", "float64", "0.0", "2.0")],
        "table string, column string, data_type string, qc_min string, qc_max string")
    bad = {r.column for r in reconcile.declared_range_check(profiles, fields).collect()}
    assert bad == {"i", "n"}


def test_profile_edges(spark):
    df = spark.createDataFrame(
        [(NAN, None, "-999", True, [1]), (2.0, None, " -999", False, [2])],
        "a double, b int, c string, d boolean, e array<int>")
    rows = {r.column: r for r in profile.profile_table(df, "t").collect()}
    assert (rows["a"].max_value, rows["a"].n_nan) == ("2.0", 1)
    assert (rows["b"].min_value, rows["b"].n_null) == (None, 2)
    assert rows["c"].has_sentinel and rows["c"].min_value is None
    assert not rows["d"].has_sentinel and not rows["e"].has_sentinel
    assert {r.column for r in profile.profile_minmax(profile.profile_table(df, "t")).collect()} == {"a"}


def test_wide_tables_are_profiled_in_column_groups(spark):
    df = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(130)])
    rows = profile.profile_table(df, "wide").orderBy("pos").collect()
    assert [(r.pos, r.column, r.min_value) for r in rows] == [(i, f"c{i}", str(i)) for i in range(130)]


def test_coordinates(spark):
    df = spark.createDataFrame([(360.0, -90.0), (0.0, 90.0)], "ra_j2000 double, dec double")
    found = {(r.column, r.check) for r in values.coordinate_findings(df, "t").collect()}
    assert found == {("ra_j2000", "ra_check")}
    other = spark.createDataFrame([(500.0,)], "rate double")
    assert values.coordinate_findings(other, "t").count() == 0
    named = values.coordinate_findings(other, "t", columns={"ra_check": "rate"})
    assert {r.check for r in named.collect()} == {"ra_check"}


def test_table_suite(spark):
    df = spark.createDataFrame([(1, 400.0, "-999")], "uberID int, ra double, Class string")
    found = {(r.column, r.check) for r in values.validate_table(df, "stars").collect()}
    assert {("ra", "ra_check"), ("Class", "sentinel_scan"), ("Class", "name_snake_case")} <= found


def test_a_missing_table_is_a_finding(spark, tmp_path):
    found, absent = tables.read_tables(spark, {"gone": str(tmp_path / "gone.parquet")})
    assert found == {} and absent == ["gone"]
    assert tables.missing_table(spark, "gone").first().check == "src_parquet"
