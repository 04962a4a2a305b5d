"""Value checks: ranges, sentinels, and the table suite."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegate.functions.findings import (
    FAIL, explode_findings, no_findings, union_findings, when_found,
)
from tablegate.operators import names
from tablegate.operators.catalog import find_column
from tablegate.operators.profile import profile_groups, profile_table, sentinel_hit
from tablegate.rules import DEFAULT_RULES, FLOAT_TYPES, INTEGER_TYPES, SENTINEL, RuleBook
from tablegate.sources.store import by_shuffle

CLOSED = ("left", "right", "both", "none")


@dataclass(frozen=True)
class RangeRule:
    """A column must lie in an interval closed on the given sides."""

    column: str
    lo: float
    hi: float
    closed: str = "both"

    def __post_init__(self) -> None:
        if self.closed not in CLOSED:
            raise ValueError(f"closed must be one of {CLOSED}, got {self.closed!r}")

    @property
    def text(self) -> str:
        left = "[" if self.closed in ("left", "both") else "("
        right = "]" if self.closed in ("right", "both") else ")"
        return f"{left}{self.lo}, {self.hi}{right}"


@dataclass(frozen=True)
class RootRule:
    """A range for the first column whose name holds a root token."""

    check: str
    root: str
    lo: float
    hi: float
    closed: str


# The two sky coordinates every table is checked for.
COORDINATE_RULES = (
    RootRule("ra_check", "ra", 0, 360, "left"),
    RootRule("dec_check", "dec", -90, 90, "both"),
)


def _bound(value, dtype: T.DataType) -> Column:
    """A bound in the column's own type where widening would change the value:
    a 32-bit 0.1 is not the 64-bit 0.1."""
    return F.lit(float(value)).cast("float") if isinstance(dtype, T.FloatType) else F.lit(value)


def inside(column: Column, dtype: T.DataType, rule: RangeRule) -> Column:
    """Null for a null value; NaN sorts above every bound and so lies outside."""
    lo, hi = _bound(rule.lo, dtype), _bound(rule.hi, dtype)
    above = column >= lo if rule.closed in ("left", "both") else column > lo
    below = column <= hi if rule.closed in ("right", "both") else column < hi
    return above & below


def all_agg(condition: Column) -> Column:
    """True unless some row is false; nulls are skipped, no rows means true."""
    return F.coalesce(F.bool_and(condition), F.lit(True))


def any_agg(condition: Column) -> Column:
    """True if some row is true; nulls are skipped, no rows means false."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def range_check(df: DataFrame, rules: list[RangeRule]) -> DataFrame:
    """One row per rule: ``column, interval, in_range, violations``; one scan for all.

    A rule on a column that is absent or not numeric yields ``in_range`` false and
    no violation count.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    aggregates, rows = [], []
    for i, rule in enumerate(rules):
        checked = isinstance(types.get(rule.column), T.NumericType)
        if checked:
            ok = inside(F.col(f"`{rule.column}`"), types[rule.column], rule)
            aggregates += [all_agg(ok).alias(f"ok_{i}"), F.count_if(~ok).alias(f"bad_{i}")]
        rows.append(F.struct(
            F.lit(rule.column).alias("column"),
            F.lit(rule.text).alias("interval"),
            (F.col(f"ok_{i}") if checked else F.lit(False)).alias("in_range"),
            (F.col(f"bad_{i}") if checked else F.lit(None)).cast("bigint").alias("violations")))
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    return wide.select(F.inline(F.array(*rows)))


def profile_in_range(lo: Column, hi: Column, closed: str) -> Column:
    """Whether a profiled column lies in an interval, from its extremes alone.

    ``lo`` and ``hi`` are text.  Integers compare as decimals (no loss beyond
    2^53), 32-bit floats against the bound rounded to 32 bits, NaN never fits.
    Bounds may be infinite; true and false are 1 and 0; nothing fits a bound
    that is no number.
    """
    dtype = F.col("dtype")
    left = closed in ("left", "both")
    right = closed in ("right", "both")

    def compare(kind: str, through: str | None = None) -> Column:
        def number(text):
            return (text.try_cast(through) if through else text).try_cast(kind)

        def bound(text):
            return F.when(text == "true", F.lit("1")).when(text == "false", F.lit("0")).otherwise(text)

        low, high = number(F.col("min_value")), number(F.col("max_value"))
        a, b = number(bound(lo)), number(bound(hi))
        return (low >= a if left else low > a) & (high <= b if right else high < b)

    fits = (
        # An infinite or huge bound is no decimal: both are then compared as doubles.
        F.when(dtype.isin(list(INTEGER_TYPES)), F.coalesce(compare("decimal(38,10)"), compare("double")))
        .when(dtype == "float32", compare("double", "float"))
        .when(dtype == "float64", compare("double"))
        .otherwise(F.lit(False)))
    empty = F.col("n_null") == F.col("n_rows")
    return F.when(empty & dtype.isin([*INTEGER_TYPES, *FLOAT_TYPES]), F.lit(True)).otherwise(
        F.coalesce(fits, F.lit(False)) & (F.col("n_nan") == 0))


def sentinel_checks() -> Column:
    return when_found(F.col("has_sentinel"), "sentinel_scan", FAIL,
                      "holds the missing-value sentinel")


def coordinate_checks(df: DataFrame, rules=COORDINATE_RULES,
                      columns: dict[str, str] | None = None) -> list[Column]:
    """Checks on profile rows for the located coordinate columns; an absent one
    passes.  ``columns`` names a column explicitly per check."""
    checks = []
    for rule in rules:
        column = (columns or {}).get(rule.check) or find_column(rule.root, df)
        if column is None:
            continue
        ok = profile_in_range(F.lit(str(rule.lo)), F.lit(str(rule.hi)), rule.closed)
        text = RangeRule(column, rule.lo, rule.hi, rule.closed).text
        checks.append(when_found((F.col("column") == column) & ~ok, rule.check, FAIL,
                                 f"{column} not in {text}"))
    return checks


def coordinate_findings(df: DataFrame, table: str, rules=COORDINATE_RULES,
                        columns: dict[str, str] | None = None) -> DataFrame:
    """Findings of the coordinate rules on one table; reads only their columns."""
    used = [c for c in ((columns or {}).get(r.check) or find_column(r.root, df) for r in rules) if c]
    checks = coordinate_checks(df, rules, columns) or [no_findings()]
    profiles = profile_table(df.select(*[f"`{c}`" for c in dict.fromkeys(used)]), table) \
        if used else profile_table(df.select(F.lit(0).alias("none")), table)
    return explode_findings(profiles, ["table", "column"], *checks)


def sentinel_scan(df: DataFrame, table: str, sentinel: int = SENTINEL) -> DataFrame:
    """Numeric and text columns with their sentinel verdict, in schema order.

    Only rows with a hit in some column are aggregated: on Parquet the condition reaches the scan, which
    passes over row groups whose statistics leave no room for the sentinel.  On a clean table these are
    nearly all.
    """
    checkable = [f for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    if not checkable:
        return profile_table(df.select(), table, sentinel).select("table", "column", "has_sentinel")
    hits = [sentinel_hit(F.col(f"`{f.name}`"), f.dataType, sentinel) for f in checkable]
    found = df.select(*[f"`{f.name}`" for f in checkable]).where(reduce(Column.__or__, hits)).agg(
        *[any_agg(hit).alias(f"hit_{i}") for i, hit in enumerate(hits)])
    return found.select(F.lit(table).alias("table"), F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f"hit_{i}").alias("has_sentinel")) for i, f in enumerate(checkable)])))


def name_findings(df: DataFrame, table: str, file: str, book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Name-rule findings of one table, from its schema alone."""
    spark = df.sparkSession
    columns = spark.createDataFrame(
        [(table, f.name) for f in df.schema.fields], "table string, column string")
    files = spark.createDataFrame([(table, file)], "table string, file string")
    return union_findings([
        explode_findings(columns, ["table", "column"],
                         names.column_name_checks(F.col("column"), book)),
        explode_findings(files, ["table", F.lit("").alias("column")],
                         names.table_name_checks(F.col("file"), book)),
    ])


def validate_table(df: DataFrame, table: str, file: str | None = None,
                   rules=COORDINATE_RULES, columns: dict[str, str] | None = None,
                   sentinel: int = SENTINEL, book: RuleBook = DEFAULT_RULES,
                   profiles: DataFrame | None = None) -> DataFrame:
    """The table suite: table name, column names, coordinates, sentinel.

    Findings ``table, column, check, severity, message``.  The data is read once,
    for the profile (``profiles``, where it is at hand); name rules use the schema.
    """
    profiles = profile_table(df, table, sentinel) if profiles is None else profiles
    checks = [sentinel_checks(), *coordinate_checks(df, rules, columns)]
    data = explode_findings(profiles, ["table", "column"], *checks)
    return union_findings([name_findings(df, table, file or f"{table}.parquet", book), data])


def validate_groups(df: DataFrame, keys: list[str], table: str, rules=COORDINATE_RULES,
                    sentinel: int = SENTINEL, book: RuleBook = DEFAULT_RULES,
                    profiles: DataFrame | None = None) -> DataFrame:
    """The table suite for many tables of one schema that lie in one: ``<keys>, column, check, severity,
    message``.  ``keys`` tell the tables, the one named ``table`` holds their names.  The data is
    read once, or not at all where ``profiles`` (``profile_groups`` of it) is given."""
    rows = profile_groups(df, keys, sentinel) if profiles is None else profiles
    data = df.drop(*keys)
    found = explode_findings(rows, [*keys, "column"], sentinel_checks(), *coordinate_checks(data, rules))
    columns = names.validate_column_names(rows, "column", book).withColumnRenamed("name", "column")
    tables = by_shuffle(rows.select(*keys).distinct())
    named = tables.join(names.validate_table_names(tables, table, book).withColumnRenamed("file", table), table).select(
        *keys, F.lit("").alias("column"), "check", "severity", "message")
    return union_findings([
        found, rows.select(*keys, "column").join(columns, "column").select(*keys, "column", "check", "severity", "message"),
        named])
