"""Column catalogs: one row per table and column, and lookups over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegate.functions.findings import FAIL, explode_findings, when_found
from tablegate.rules import DATA_TYPES
from tablegate.sources.folders import opened, readable

CATALOG_TYPE = "table string, pos int, column string, dtype string"

# Spark type -> declared type name.
TYPE_NAMES = {
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.BooleanType: "boolean",
    T.StringType: "string",
}


def type_name(dtype: T.DataType) -> str:
    return TYPE_NAMES.get(type(dtype), dtype.simpleString())


def schema_rows(df: DataFrame, table: str) -> list[tuple]:
    return [(table, pos, field.name, type_name(field.dataType))
            for pos, field in enumerate(df.schema.fields)]


def unsigned_columns(df: DataFrame) -> dict[str, str]:
    """Columns that the Parquet footer declares unsigned, which Spark reads as wider signed
    ones: name to declared type.  One footer is read, through Spark's own file system."""
    files = sorted(df.inputFiles())
    if not files:
        return {}
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop
    parquet = spark._jvm.org.apache.parquet.hadoop
    source = parquet.util.HadoopInputFile.fromPath(
        hadoop.fs.Path(files[0]), spark._jsparkSession.sessionState().newHadoopConf())
    reader = parquet.ParquetFileReader.open(source)
    try:
        found = {}
        for field in reader.getFooter().getFileMetaData().getSchema().getFields():
            logical = field.getLogicalTypeAnnotation()
            match = re.fullmatch(r"INTEGER\((\d+),false\)", logical.toString() if logical is not None else "")
            if match:
                found[field.getName()] = f"uint{match[1]}"
        return found
    finally:
        reader.close()


FOOTER_TYPE = "table string, file string, pos int, column string, dtype string"
#: Arrow's names of types that are declared otherwise.
ARROW_NAMES = {"float": "float32", "halffloat": "float16", "double": "float64", "bool": "boolean", "large_string": "string"}


def _read_footers(batches):
    """The columns of Parquet files, from their footers."""
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for table, file in zip(batch["table"], batch["file"]):
            system, location, _ = opened(file)
            with system.open_input_file(location) as source:
                schema = pq.read_schema(source)
            rows += [(table, file, pos, field.name, ARROW_NAMES.get(str(field.type), str(field.type)))
                     for pos, field in enumerate(schema)]
        yield pd.DataFrame(rows, columns=["table", "file", "pos", "column", "dtype"])


def file_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns that every Parquet file of the tables declares: ``table, file, pos, column, dtype``.

    Footers are read in tasks, files dealt out evenly; no data is.  Of files that only Spark's own file
    systems open, one footer a table is read, by the driver.
    """
    files = [(table, file) for table, df in tables.items() for file in df.inputFiles()]
    rows, near = [], []
    for table, file in files:
        if readable(file):
            near.append((table, file))
        elif not any(row[0] == table for row in rows):
            unsigned = unsigned_columns(tables[table])
            rows += [(table, file, pos, name, unsigned.get(name, dtype)) for _, pos, name, dtype in schema_rows(tables[table], table)]
    far = spark.createDataFrame(rows, FOOTER_TYPE)
    if not near:
        return far
    given = spark.createDataFrame(near, "table string, file string").repartition(max(1, min(len(near), 1000)))
    read = given.mapInPandas(_read_footers, FOOTER_TYPE)
    return read.unionByName(far) if rows else read


def file_schema_check(footers: DataFrame) -> DataFrame:
    """Findings for columns that a table's files do not agree on: another type, or absent in some.

    Spark takes one file's schema for the table's; what the others hold is then read as null, or fails.
    """
    files = footers.groupBy("table").agg(F.count_distinct("file").alias("files"))
    columns = footers.groupBy("table", "column").agg(
        F.array_sort(F.collect_set("dtype")).alias("types"), F.count_distinct("file").alias("have"))
    check = "file_schema_check"
    return explode_findings(
        columns.join(files, "table"), ["table", "column"],
        when_found(F.size("types") > 1, check, FAIL, F.concat(F.lit("types differ between files: "), F.concat_ws(", ", "types"))),
        when_found(F.col("have") < F.col("files"), check, FAIL,
                   F.concat(F.lit("in "), F.col("have"), F.lit(" of "), F.col("files"), F.lit(" files"))))


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The catalog of several tables as read from Parquet, from their schemas and their files' footers
    (no data is scanned): a column that some file declares unsigned is unsigned."""
    rows = spark.createDataFrame([row for table, df in tables.items() for row in schema_rows(df, table)], CATALOG_TYPE)
    unsigned = (file_columns(spark, tables).filter(F.col("dtype").startswith("uint"))
                .groupBy("table", "column").agg(F.min("dtype").alias("__declared")))
    return rows.join(unsigned, ["table", "column"], "left").select(
        "table", "pos", "column", F.coalesce("__declared", "dtype").alias("dtype"))


def has_root(column: Column, root: str) -> Column:
    """Whether one of the name's underscore tokens equals the root, case included."""
    return F.array_contains(F.split(column, "_"), root)


def find_column(root: str, df: DataFrame) -> str | None:
    """First column of one table whose name holds the root as a token."""
    return next((name for name in df.columns if root in name.split("_")), None)


def find_columns(columns: DataFrame, root: str) -> DataFrame:
    """The same for a whole catalog: first matching column per table.

    ``min_by`` combines before the shuffle, so a table with very many columns
    sends one candidate per input partition.
    """
    return (columns.filter(has_root(F.col("column"), root))
            .groupBy("table").agg(F.min_by("column", "pos").alias("column")))


def type_support_check(columns: DataFrame) -> DataFrame:
    """Findings for columns whose type is outside the accepted set."""
    return explode_findings(columns, ["table", "column"], when_found(
        ~F.col("dtype").isin(list(DATA_TYPES)), "type_support_check", FAIL,
        F.concat(F.lit("unsupported type "), F.col("dtype"))))


def first_match(df: DataFrame, keys: list, value: str, order) -> DataFrame:
    """First value per key in a given order."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))
