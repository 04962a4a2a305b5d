"""Whole-folder suites.

A suite is a union of findings over shared inputs.  Everything stays a DataFrame:
many datasets are checked in one job, and the gate is one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.functions.findings import FAIL, explode_findings, no_findings, union_findings, when_found
from tablegate.operators import catalog, documents, history, profile, reconcile, report, rollup, values
from tablegate.rules import DEFAULT_RULES, RuleBook
from tablegate.sources import documents as sources
from tablegate.sources import inventory, manifests
from tablegate.sources.store import by_shuffle, stored

FOLDER_CHECKS = (
    "docs_without_table", "tables_without_doc", "notes_check", "extra_files",
    "dataset_name_check", "version_check",
)


def check_directory(files: DataFrame, docs: DataFrame, declared: DataFrame,
                    expected: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """The folder suite: ``dataset, subject, check, severity, message``.

    ``files``: inventory; ``docs``: ``dataset, name, declared_dataset``; ``declared``:
    ``dataset, table, version``; ``expected``: ``dataset, table, next_version``;
    ``datasets``: ``dataset`` of every folder, also of empty ones.
    """
    folder = union_findings([
        reconcile.folder_checks(files, datasets), reconcile.dataset_name_check(docs),
    ]).withColumnRenamed("name", "subject")
    versions = history.version_check(declared, expected).withColumnRenamed("table", "subject")
    return folder.unionByName(versions)


SUITES = ("table", "document", "consistency", "folder", "rollup")


@dataclass
class ReleaseInputs:
    """What the release check reads; every table may hold any number of datasets.

    ``files``: inventory ``dataset, name, stem, kind``.  ``documents``: ``dataset, name, raw`` (and
    ``parse_error``).  ``profiles``: ``dataset, table`` and profile rows, ``table`` being a table file's stem.
    ``table_findings``: ``dataset, table, column, check, severity, message``.  ``rollups``: ``dataset, file, raw``
    of the datasets that have one.  ``releases``: ``dataset, next_release``.  ``datasets``: all folders, also
    those without files.  ``expected``: ``dataset, table, next_version``; where it is not given, it follows
    from the published ``checksums`` (``dataset, release, file, sha1``) and ``versions`` (``dataset, release,
    table, table_version``) and from the files' ``sha1``.
    """

    files: DataFrame
    documents: DataFrame
    profiles: DataFrame
    table_findings: DataFrame
    rollups: DataFrame
    releases: DataFrame
    datasets: DataFrame
    vocabulary: DataFrame | None = None
    expected: DataFrame | None = None
    checksums: DataFrame | None = None
    versions: DataFrame | None = None


def table_key(dataset: Column, table: Column) -> Column:
    """One text that names a table of a dataset."""
    return F.concat(dataset, F.lit("/"), table)


def expected_versions(headers: DataFrame, files: DataFrame, checksums: DataFrame, versions: DataFrame) -> DataFrame:
    """The version that each documented table (``dataset, name, table``; ``name`` is the document's file) has to
    carry after its published history: ``dataset, table, next_version``."""
    hashes = files.select("dataset", F.col("name").alias("file"), "sha1")
    local = headers.filter(F.col("table").isNotNull()).select(
        "dataset", "table", F.regexp_replace("name", r"\.maml$", ".parquet").alias("file")).join(by_shuffle(hashes), ["dataset", "file"], "left")
    return history.next_table_version(local, history.last_seen_by_file(local, checksums, versions))


def read_release(spark: SparkSession, folders: list[str], releases: DataFrame, checksums: DataFrame, versions: DataFrame,
                 vocabulary: DataFrame | None = None, book: RuleBook = DEFAULT_RULES) -> tuple[ReleaseInputs, DataFrame]:
    """The inputs of a release check from release folders, and the hashes of their files.

    A folder is listed, and its files hashed, once.  Every table has a plan of its own for its profile,
    as it has its own schema; its rows are read once.
    """
    files = stored(inventory.hashed_inventory(spark, folders))
    held = {(r.dataset, r.kind, r.rolled) for r in files.select(
        "dataset", "kind", F.endswith("name", F.lit(".daml")).alias("rolled")).distinct().collect()}  # a few rows a folder
    of = {folder.rstrip("/").rsplit("/", 1)[-1]: folder.rstrip("/") for folder in folders}

    def read(pattern: str, wanted) -> DataFrame:
        paths = [f"{of[dataset]}/{pattern}" for dataset, kind, rolled in sorted(held) if wanted(kind, rolled)]
        docs = sources.read_documents(spark, paths) if paths else spark.createDataFrame([], "file string, raw string, parse_error string")
        return docs.select(F.regexp_extract("file", r"([^/]+)/[^/]*$", 1).alias("dataset"),
                           inventory.file_name(F.col("file")).alias("file"), "raw", "parse_error")

    documents_ = read("*.maml", lambda kind, _: kind == reconcile.DOCUMENT)
    rollups = read("*.daml", lambda _, rolled: rolled)
    rows = files.filter(F.col("kind") == reconcile.TABLE).select("dataset", "path", "name", "stem").collect()  # names
    tables = {f"{row.dataset}/{row.stem}": spark.read.parquet(row.path) for row in rows}
    if tables:
        profiles = profile.profile_tables(tables, footers=catalog.file_columns(spark, tables))
    else:
        profiles = profile.profile_table(spark.createDataFrame([], "x int"), "").limit(0)
    profiles = stored(profiles)  # read for the findings and for the comparison with the documents
    found = [values.validate_table(table, key, row.name, book=book, profiles=profiles.filter(F.col("table") == key))
             for (key, table), row in zip(tables.items(), rows)]
    about = union_findings(found) if found else explode_findings(profiles, ["table", "column"], no_findings())

    def apart(df: DataFrame) -> DataFrame:
        """The dataset and the table of a key of both."""
        return df.withColumn("dataset", F.regexp_extract("table", "^(.*)/[^/]*$", 1)).withColumn(
            "table", F.regexp_extract("table", "([^/]*)$", 1))

    given = ReleaseInputs(
        files=files, documents=documents_.withColumnRenamed("file", "name"), profiles=apart(profiles),
        table_findings=apart(about), rollups=rollups, releases=releases, vocabulary=vocabulary,
        datasets=inventory.datasets_of(spark, folders), checksums=checksums, versions=versions)
    return given, files.filter(F.col("length").isNotNull()).select("dataset", "name", "sha1")


def release_findings(given: ReleaseInputs, book: RuleBook = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """The findings of all suites about all datasets, and the documents' headers.

    Findings: ``dataset, table, suite, subject, check, severity, message``; ``table`` is null where a finding
    is about the folder.  The suites depend on each other: a table is held against its document only if that
    is valid.  What rests on a document that failed fails with it, as the finding ``document_failed``.
    Every document is opened once, every table profiled once.
    """
    key = table_key(F.col("dataset"), F.col("name"))
    error = ["parse_error"] if "parse_error" in given.documents.columns else []
    typed = stored(documents.typed_documents(given.documents.select(key.alias("file"), "raw", *error), book))
    about = stored(documents.validate_documents(typed, given.vocabulary, book))  # read by three suites
    folder_of, name_of = F.regexp_extract("file", "^(.*)/[^/]*$", 1), F.regexp_extract("file", "([^/]*)$", 1)
    stem = inventory.known_stem(F.col("file"))
    headers = documents.documents_to_headers(typed).withColumnRenamed("dataset", "declared_dataset").select(
        folder_of.alias("dataset"), name_of.alias("name"), "*")

    # Tables against valid documents, matched by the stem of their files.
    fields = documents.documents_to_fields(typed, about, table=stem)
    profiles = given.profiles.withColumn("table", table_key(F.col("dataset"), F.col("table"))).drop("dataset")
    tables = by_shuffle(profiles.select("table").distinct())
    failed = by_shuffle(about.filter(F.col("severity") == FAIL).select(stem.alias("table")).distinct())
    valid = by_shuffle(typed.filter(F.col("header").isNotNull()).select(stem.alias("table")).join(failed, "table", "left_anti"))
    consistent = reconcile.validate_consistency(
        profiles.join(valid, "table", "left_semi"), fields.join(tables, "table", "left_semi"))
    blocked = explode_findings(failed.join(tables, "table", "left_semi"), ["table", F.lit("").alias("column")], when_found(
        F.lit(True), "document_failed", FAIL, "not checked, its document failed"))

    declared = headers.filter(F.col("table").isNotNull()).select("dataset", "table", "version")
    expected = given.expected if given.expected is not None else expected_versions(
        headers, given.files, given.checksums, given.versions)
    folder = check_directory(
        given.files, headers.select("dataset", "name", "declared_dataset"), declared, expected, given.datasets)
    rollups = rollup.validate_rollup(
        given.rollups, declared.select("dataset", F.col("table").alias("name"), "version"), given.releases)

    def in_shape(found: DataFrame, suite: str, dataset, table, subject) -> DataFrame:
        return found.select(dataset.alias("dataset"), table.alias("table"), F.lit(suite).alias("suite"),
                            subject.alias("subject"), "check", "severity", "message")

    none = F.lit(None).cast("string")
    of, only = F.regexp_extract("table", "^(.*)/[^/]*$", 1), F.regexp_extract("table", "([^/]*)$", 1)
    found = union_findings([
        in_shape(given.table_findings, "table", F.col("dataset"), F.col("table"), F.col("column")),
        in_shape(about, "document", folder_of, inventory.known_stem(name_of), name_of),
        in_shape(consistent.unionByName(blocked), "consistency", of, only, F.col("column")),
        in_shape(folder, "folder", F.col("dataset"), none, F.col("subject")),
        in_shape(rollups, "rollup", F.col("dataset"), none, F.col("subject"))])
    return found, headers


@dataclass
class Release:
    """What passed the gate and what is to be written for it."""

    gate: DataFrame
    rollups: DataFrame
    manifests: DataFrame


def release(datasets: DataFrame, findings: DataFrame, docs: DataFrame, releases: DataFrame,
            hashes: DataFrame, date: str, with_rollup: DataFrame | None = None) -> Release:
    """Gate datasets and prepare the outputs of those that pass.

    ``findings`` needs ``dataset`` and ``severity``.  A passing dataset that has no
    rollup document yet (``with_rollup`` lists those that do) gets its rollup rows; one
    that has gets its manifest lines.
    """
    gate = report.dataset_gate(datasets, findings)
    passing = by_shuffle(gate.filter("passes").select("dataset"))
    if with_rollup is None:
        fresh, ready = passing, passing.filter(F.lit(False))
    else:
        done = by_shuffle(with_rollup.select("dataset").distinct())
        fresh = passing.join(done, "dataset", "left_anti")
        ready = passing.join(done, "dataset", "left_semi")
    rollups = rollup.build_rollup(docs.join(by_shuffle(fresh), "dataset", "left_semi"), releases, date)
    lines = manifests.manifest_lines(hashes.join(by_shuffle(ready), "dataset", "left_semi"))
    return Release(gate, rollups, lines)


def check_release(given: ReleaseInputs, hashes: DataFrame, date: str, book: RuleBook = DEFAULT_RULES) -> tuple[DataFrame, Release]:
    """The whole release check: the findings of all suites, kept as a table, and what the gate lets through.

    First pass: a passing dataset without a rollup document gets one.  Second pass, with the rollup in
    its folder: it gets its manifest (``hashes``: ``dataset, name, sha1`` of its files).
    """
    found, headers = release_findings(given, book)
    findings = stored(found)
    docs = headers.drop("file").withColumnRenamed("name", "file")
    return findings, release(given.datasets, findings, docs, given.releases, hashes, date, given.rollups.select("dataset"))
