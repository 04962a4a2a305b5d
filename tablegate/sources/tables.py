"""Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.functions.findings import FAIL


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def missing_table(spark: SparkSession, table: str) -> DataFrame:
    """The finding that stands for a table whose file is absent."""
    row = [(table, "", "src_parquet", FAIL, "file not found")]
    return spark.createDataFrame(
        row, "table string, column string, check string, severity int, message string"
    ).withColumn("severity", F.col("severity").cast("tinyint"))


def read_tables(spark: SparkSession, paths: dict[str, str]) -> tuple[dict, list[str]]:
    """Tables by name, and the names whose file is absent."""
    found, absent = {}, []
    for name, path in paths.items():
        df = read_table(spark, path)
        if df is None:
            absent.append(name)
        else:
            found[name] = df
    return found, absent
