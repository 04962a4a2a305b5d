"""Findings as values.

A check is a Column of type ``array<finding>``; a suite is the concatenation of
its checks' arrays, exploded once.  A suite therefore reads its input in a single
narrow pass, however many checks it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, WARN, FAIL = 0, 1, 2

FINDING_TYPE = "struct<check:string,severity:tinyint,message:string>"


def finding(check: str, severity: int, message: Column | str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(severity).cast("tinyint").alias("severity"),
        text.alias("message"),
    )


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING_TYPE}>")


def when_found(condition: Column, check: str, severity: int, message: Column | str) -> Column:
    """One finding where the condition holds, none where it is false or null."""
    return F.when(condition, F.array(finding(check, severity, message))).otherwise(no_findings())


def for_each(items: Column, check: str, severity: int, message) -> Column:
    """One finding per element of an array; ``message`` maps an element to text."""
    return F.transform(items, lambda item: finding(check, severity, message(item)))


def all_of(*checks: Column) -> Column:
    return F.concat(*checks) if len(checks) > 1 else checks[0]


def explode_findings(df: DataFrame, keys: list, *checks: Column) -> DataFrame:
    """One row per finding, keyed by ``keys``; rows without findings vanish.

    The outer form is used on purpose: for the inner one the optimizer adds a filter
    on the array's size, which evaluates every check a second and a third time.
    """
    return df.select(*keys, F.inline_outer(all_of(*checks))).filter(F.col("check").isNotNull())


def explode_once(df: DataFrame, keys: list, items: Column, *names: str) -> DataFrame:
    """Explode an array (one name) or its positions and elements (two names) without
    having the array evaluated again for an inferred filter.  Null elements vanish."""
    exploded = F.posexplode_outer(items) if len(names) == 2 else F.explode_outer(items)
    return df.select(*keys, exploded.alias(*names)).filter(F.col(names[-1]).isNotNull())


def state(findings: Column) -> Column:
    """Worst severity held by an array of findings (0 when it is empty)."""
    worst = F.array_max(F.transform(findings, lambda f: f["severity"]))
    return F.coalesce(worst, F.lit(PASS).cast("tinyint"))


def union_findings(frames: list[DataFrame]) -> DataFrame:
    """The union of frames of the same columns, in halves: a plan of many frames is not analysed again for each."""
    while len(frames) > 1:
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) & ~1:]
    return frames[0]
