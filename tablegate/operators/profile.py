"""One-pass table profiles.

Range, sentinel and declared-range checks all read the same per-column
aggregates, so a table is scanned once however many rules apply to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegate.functions.findings import union_findings
from tablegate.operators.catalog import type_name
from tablegate.rules import SENTINEL

PROFILE_TYPE = ("struct<pos:int,column:string,dtype:string,n_rows:bigint,n_null:bigint,"
                "n_nan:bigint,min_value:string,max_value:string,has_sentinel:boolean>")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def has_range(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def has_sentinel(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.StringType))


def sentinel_hit(column: Column, dtype: T.DataType, sentinel: int = SENTINEL) -> Column:
    """Equality with the sentinel; text columns compare with its text."""
    return column == (F.lit(str(sentinel)) if isinstance(dtype, T.StringType) else F.lit(sentinel))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Aggregates and rows are SQL text: a plan of hundreds of tables has thousands of expressions, and each
# one built call by call would cost more than reading a small table.

def _aggregates(pos: int, field: T.StructField, sentinel: int) -> list[str]:
    column, dtype = _quoted(field.name), field.dataType
    out = [f"count({column}) AS count_{pos}"]
    if is_floating(dtype):
        out.append(f"count_if(isnan({column})) AS nan_{pos}")
    if has_range(dtype):
        least = most = column
        if is_floating(dtype):
            # Without negative zero: which of two equal zeros is met first must not show.
            least = most = f"({column} + CAST(0 AS {dtype.simpleString()}))"
            most = f"CASE WHEN NOT isnan({column}) THEN {most} END"  # NaN counts only when there is nothing else
        largest = f"max({most})" if most == least else f"coalesce(max({most}), max({least}))"
        out += [f"CAST(min({least}) AS STRING) AS min_{pos}", f"CAST({largest} AS STRING) AS max_{pos}"]
    if has_sentinel(dtype):
        value = _text(str(sentinel)) if isinstance(dtype, T.StringType) else str(sentinel)
        out.append(f"coalesce(bool_or({column} = {value}), false) AS hit_{pos}")
    return out


def _profile_row(pos: int, field: T.StructField) -> str:
    dtype = field.dataType
    ranged = has_range(dtype)
    parts = {
        "pos": str(pos), "column": _text(field.name), "dtype": _text(type_name(dtype)), "n_rows": "n_rows",
        "n_null": f"n_rows - count_{pos}", "n_nan": f"nan_{pos}" if is_floating(dtype) else "0L",
        "min_value": f"min_{pos}" if ranged else "CAST(NULL AS STRING)",
        "max_value": f"max_{pos}" if ranged else "CAST(NULL AS STRING)",
        "has_sentinel": f"hit_{pos}" if has_sentinel(dtype) else "false"}
    return f"struct({', '.join(f'{value} AS {name}' for name, value in parts.items())})"


def _profiled(df: DataFrame, fields: list, keys: list[str], sentinel: int) -> tuple[DataFrame, Column]:
    """The one aggregate over a table, and its columns' profile rows."""
    aggregates = [agg for pos, field in fields for agg in _aggregates(pos, field, sentinel)]
    wide = df.groupBy(*[F.col(_quoted(k)) for k in keys]).agg(*[F.expr(a) for a in ("count(1) AS n_rows", *aggregates)])
    rows = ", ".join(_profile_row(pos, field) for pos, field in fields)
    return wide, F.expr(f"inline(CAST(array({rows}) AS array<{PROFILE_TYPE}>))")


def profile_table(df: DataFrame, table: str, sentinel: int = SENTINEL, footers: DataFrame | None = None) -> DataFrame:
    """Profile rows ``table, pos, column, dtype, n_rows, n_null, n_nan, min_value,
    max_value, has_sentinel`` of one table: one scan, one aggregate, however wide.

    Spark reads unsigned Parquet columns as wider signed ones; with ``footers``
    (``catalog.file_columns``) the type is the one the files declare.
    """
    wide, rows = _profiled(df, list(enumerate(df.schema.fields)), [], sentinel)
    profiles = wide.select(F.lit(table).alias("table"), rows)
    return profiles if footers is None else with_declared_types(profiles, footers)


def profile_groups(df: DataFrame, keys: list[str], sentinel: int = SENTINEL) -> DataFrame:
    """Profile rows of many tables of one schema that lie in one: one scan and one grouped aggregate.
    ``keys`` tell the tables and come first; a table of many rows is combined before the shuffle."""
    fields = list(enumerate(f for f in df.schema.fields if f.name not in keys))
    wide, rows = _profiled(df, fields, keys, sentinel)
    return wide.select(*keys, rows)


def with_declared_types(profiles: DataFrame, footers: DataFrame) -> DataFrame:
    """Profile rows with the types that the files' footers declare where these are unsigned."""
    declared = (footers.filter(F.col("dtype").startswith("uint")).groupBy("table", "column")
                .agg(F.min("dtype").alias("__declared")))
    return profiles.join(declared, ["table", "column"], "left").select(
        *[F.coalesce("__declared", "dtype").alias("dtype") if c == "dtype" else c for c in profiles.columns])


def profile_tables(tables: dict[str, DataFrame], sentinel: int = SENTINEL, footers: DataFrame | None = None) -> DataFrame:
    profiles = union_findings([profile_table(df, name, sentinel) for name, df in tables.items()])
    return profiles if footers is None else with_declared_types(profiles, footers)


def profile_minmax(profiles: DataFrame) -> DataFrame:
    """Declared-range candidates: numeric columns with at least one value."""
    numeric = F.col("dtype").rlike("^(int|float|tinyint|decimal)")
    return profiles.filter(numeric & F.col("min_value").isNotNull()).select(
        "table", "pos", "column", "dtype", "min_value", "max_value")
