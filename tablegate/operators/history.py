"""Versions decided from the published history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.functions.findings import FAIL, explode_findings, when_found
from tablegate.sources.store import by_shuffle


def release_number(folder: Column) -> Column:
    """Number of a release folder ``vN``; null for any other name."""
    return F.regexp_extract(F.trim(folder), r"\Av(\d+)\z", 1).try_cast("int")


def next_release_version(folders: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Next release per dataset from ``dataset, folder``: highest number plus one, 1
    for a dataset without releases.

    With a boolean column ``on_branch``, an open branch keeps its highest number.
    """
    number = release_number(F.col("folder"))
    if "on_branch" in folders.columns:
        branch = F.max(F.when(F.col("on_branch"), number))
        main = F.max(F.when(~F.col("on_branch"), number))
        version = F.coalesce(branch, main + 1, F.lit(1))
    else:
        version = F.coalesce(F.max(number) + 1, F.lit(1))
    known = folders.groupBy("dataset").agg(version.alias("next_release"))
    if datasets is None:
        return known
    return datasets.select("dataset").distinct().join(known, "dataset", "left").select(
        "dataset", F.coalesce("next_release", F.lit(1)).alias("next_release"))


def snapshots(checksums: DataFrame, versions: DataFrame) -> DataFrame:
    """Table states per release: both a hash (``dataset, release, table, sha1``) and a
    version (``dataset, release, table, table_version``) are needed."""
    return checksums.join(versions, ["dataset", "release", "table"])


def snapshot_last_seen(states: DataFrame) -> DataFrame:
    """Newest state per table.  ``max_by`` keeps one row per table and partition
    before the shuffle, so a long history does not travel."""
    usable = states.filter(F.col("sha1").isNotNull() & F.col("table_version").isNotNull())
    newest = usable.groupBy("dataset", "table").agg(
        F.max_by(F.struct("release", "sha1", "table_version"), F.col("release")).alias("s"))
    return newest.select("dataset", "table", "s.release", "s.sha1", "s.table_version")


def last_seen_by_file(local: DataFrame, checksums: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest published state of local tables (``dataset, table, file``): the newest release whose manifest
    holds the file and whose rollup holds the table.  ``checksums``: ``dataset, release, file, sha1``;
    ``versions``: ``dataset, release, table, table_version``.

    A file that was renamed, or a table that was, is looked up under its present name only; a release that
    has one of the two is passed over.  Both lookups are equi-joins, and one row for a table and file is
    kept on each partition before the last shuffle.
    """
    wanted = local.select("dataset", "table", "file").distinct()
    files = checksums.filter(F.col("sha1").isNotNull()).select("dataset", "release", "file", "sha1")
    tables = versions.filter(F.col("table_version").isNotNull()).select("dataset", "release", "table", "table_version")
    newest = (by_shuffle(wanted).join(files, ["dataset", "file"]).join(by_shuffle(tables), ["dataset", "release", "table"])
              .groupBy("dataset", "table", "file")
              .agg(F.max_by(F.struct("release", "sha1", "table_version"), F.col("release")).alias("s")))
    return newest.select("dataset", "table", "file", "s.release", "s.sha1", "s.table_version")


def next_table_version(local: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Version each local table (``dataset, table, sha1``) must carry: 1 when new, the
    last one when its content is unchanged, else one more.  A table without a local
    file counts as changed.

    Where both sides name the ``file`` (``last_seen_by_file``), they meet by table and file; of a table
    that several files declare, the last file's version holds.
    """
    by_file = "file" in local.columns and "file" in last_seen.columns
    keys = ["dataset", "table", *(["file"] if by_file else [])]
    seen = last_seen.select(*keys, F.col("sha1").alias("seen_sha1"),
                            F.col("table_version").alias("seen_version"))
    same = F.coalesce(F.col("sha1"), F.lit("")) == F.col("seen_sha1")
    version = (F.when(F.col("seen_version").isNull(), F.lit(1))
               .when(same, F.col("seen_version")).otherwise(F.col("seen_version") + 1))
    decided = local.join(by_shuffle(seen), keys, "left").select(*keys, version.cast("int").alias("next_version"))
    if not by_file:
        return decided
    return decided.groupBy("dataset", "table").agg(F.max_by("next_version", "file").alias("next_version"))


def version_check(declared: DataFrame, expected: DataFrame) -> DataFrame:
    """Tables whose declared version (``dataset, table, version``) is not the expected."""
    joined = expected.join(by_shuffle(declared), ["dataset", "table"], "left")
    return explode_findings(joined, ["dataset", "table"], when_found(
        ~F.col("version").eqNullSafe(F.col("next_version")), "version_check", FAIL,
        F.concat(F.lit("version "), F.coalesce(F.col("version").cast("string"), F.lit("missing")),
                 F.lit(" should be "), F.col("next_version"))))
