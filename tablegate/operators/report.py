"""Roll findings up to states, reports and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.functions.findings import FAIL, PASS, WARN
from tablegate.sources.store import by_shuffle


def finding_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    """State of every subject and check: the worst severity of its findings.

    A maximum combines before the shuffle, so findings piling up on one subject
    cost one row per input partition.
    """
    return findings.groupBy(*keys, "check").agg(F.max("severity").alias("severity"))


def severity_name(severity: Column) -> Column:
    return (F.when(severity == PASS, "PASS").when(severity == WARN, "WARNING")
            .when(severity == FAIL, "FAIL"))


def overall(worst: Column, warned: Column) -> Column:
    return (F.when(worst >= FAIL, "INVALID").when(warned, "VALID (with warnings)")
            .otherwise("VALID"))


def report_rollup(findings: DataFrame, keys: list[str], subjects: DataFrame | None = None) -> DataFrame:
    """Per subject: ``is_valid`` (no check failed), ``has_warnings`` (some check's state
    is a warning) and the overall label.  ``subjects`` adds those without findings."""
    states = finding_severity(findings, keys)
    rolled = states.groupBy(*keys).agg(
        F.max("severity").alias("worst"), F.bool_or(F.col("severity") == WARN).alias("warned"))
    if subjects is not None:
        rolled = subjects.select(*keys).distinct().join(rolled, keys, "left")
    worst = F.coalesce(F.col("worst").cast("int"), F.lit(PASS))
    warned = F.coalesce(F.col("warned"), F.lit(False))
    return rolled.select(*keys, (worst < FAIL).alias("is_valid"), warned.alias("has_warnings"),
                         overall(worst, warned).alias("overall"))


def report_filter(findings: DataFrame, keys: list[str], checks: list[str] | None = None,
                  subjects: DataFrame | None = None, verbose: bool = False) -> DataFrame:
    """States to show: the checks that did not pass, or with ``verbose`` every check of
    every subject."""
    states = finding_severity(findings, keys)
    if verbose:
        every = subjects.select(*keys).distinct().withColumn(
            "check", F.explode(F.array(*[F.lit(c) for c in checks])))
        states = every.join(states, [*keys, "check"], "left").withColumn(
            "severity", F.coalesce(F.col("severity"), F.lit(PASS).cast("tinyint")))
    else:
        states = states.filter(F.col("severity") > PASS)
    return states.select(*keys, "check", severity_name(F.col("severity")).alias("state"))


def dataset_gate(datasets: DataFrame, findings: DataFrame) -> DataFrame:
    """A dataset passes when nothing found about it is a failure; warnings are allowed."""
    worst = findings.groupBy("dataset").agg(F.max("severity").alias("worst"))
    return datasets.select("dataset").distinct().join(by_shuffle(worst), "dataset", "left").select(
        "dataset", (F.coalesce(F.col("worst").cast("int"), F.lit(PASS)) < FAIL).alias("passes"))
