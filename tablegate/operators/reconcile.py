"""Joins between data, metadata, file inventories and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.functions.findings import FAIL, FINDING_TYPE, explode_findings, finding, union_findings, when_found
from tablegate.operators.values import profile_in_range
from tablegate.sources.store import by_shuffle

DOCUMENT, TABLE, NOTES, EXTRA = "maml", "parquet", "md", "extra"


# --- data against declared columns -------------------------------------------

def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def match_columns(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """Full outer join of a catalog (or profile) and declared fields on
    ``table, column``, with ``in_data`` and ``in_metadata``."""
    data = columns.withColumn("__data", F.lit(True))
    declared = fields.select("table", "column", *[c for c in ("data_type", "qc_min", "qc_max")
                                                  if c in fields.columns],
                             F.lit(True).alias("__declared"))
    joined = data.join(declared, ["table", "column"], "full_outer")
    return (joined.withColumn("in_data", F.coalesce("__data", F.lit(False)))
            .withColumn("in_metadata", F.coalesce("__declared", F.lit(False)))
            .drop("__data", "__declared"))


def presence_check():
    return [
        when_found(F.col("in_data") & ~F.col("in_metadata"), "column_presence", FAIL,
                   "in the data but not in the metadata"),
        when_found(F.col("in_metadata") & ~F.col("in_data"), "column_presence", FAIL,
                   "in the metadata but not in the data"),
    ]


def type_check():
    both = F.col("in_data") & F.col("in_metadata")
    return when_found(
        both & (F.lower("dtype") != F.lower("data_type")), "column_type_check", FAIL,
        F.concat(F.lit("declared "), F.col("data_type"), F.lit(", is "), F.col("dtype")))


def declared_range():
    """Range check of a matched profile row; columns without a declared range pass."""
    both = F.col("in_data") & F.col("in_metadata")
    declared = F.col("qc_min").isNotNull() & F.col("qc_max").isNotNull()
    outside = ~profile_in_range(F.col("qc_min"), F.col("qc_max"), "both")
    return when_found(both & declared & outside, "declared_range_check", FAIL,
                      F.concat(F.lit("not in ["), F.col("qc_min"), F.lit(", "),
                               F.col("qc_max"), F.lit("]")))


def column_presence(columns: DataFrame, fields: DataFrame) -> DataFrame:
    return explode_findings(match_columns(columns, fields), ["table", "column"], *presence_check())


def column_type_check(columns: DataFrame, fields: DataFrame) -> DataFrame:
    return explode_findings(match_columns(columns, fields), ["table", "column"], type_check())


def declared_range_check(profiles: DataFrame, fields: DataFrame) -> DataFrame:
    return explode_findings(match_columns(profiles, fields), ["table", "column"], declared_range())


def validate_consistency(profiles: DataFrame, fields: DataFrame) -> DataFrame:
    """Presence, type and declared range of every column, in one join."""
    return explode_findings(match_columns(profiles, fields), ["table", "column"],
                            *presence_check(), type_check(), declared_range())


# --- release folders ---------------------------------------------------------

def _of_kind(files: DataFrame, kind: str) -> DataFrame:
    return files.filter(F.col("kind") == kind)


def _folder_findings(rows: DataFrame, check: str, message: str) -> DataFrame:
    return explode_findings(rows, ["dataset", "name"], when_found(F.lit(True), check, FAIL, message))


def _per_folder(files: DataFrame, datasets: DataFrame | None, condition) -> DataFrame:
    """``dataset, n``: how many files meet a condition, also for given datasets without files."""
    counted = files.groupBy("dataset").agg(F.count_if(condition).alias("n"))
    if datasets is None:
        return counted
    nothing = datasets.select("dataset", F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(nothing).groupBy("dataset").agg(F.max("n").alias("n"))


def _unpaired(files: DataFrame, kind: str, partner: str, check: str, datasets: DataFrame | None) -> DataFrame:
    own, other = _of_kind(files, kind), _of_kind(files, partner)
    alone = own.join(by_shuffle(other.select("dataset", "stem")), ["dataset", "stem"], "left_anti")
    without = _per_folder(files, datasets, F.col("kind") == kind).filter("n = 0")
    return union_findings([
        _folder_findings(alone, check, f"no .{partner} of the same name"),
        _folder_findings(without.withColumn("name", F.lit("")), check, f"no .{kind} files"),
    ])


def docs_without_table(files: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Table documents without a table of the same stem; folders without documents.
    ``datasets`` names the folders, so that one without any file is found too."""
    return _unpaired(files, DOCUMENT, TABLE, "docs_without_table", datasets)


def tables_without_doc(files: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    return _unpaired(files, TABLE, DOCUMENT, "tables_without_doc", datasets)


def notes_check(files: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """A folder needs ``<dataset>.md``; its other notes need a table.  A folder
    without its own notes gets that one finding only."""
    return folder_checks(files, datasets, ("notes_check",))


def _own_extra() -> Column:
    """A dataset's manifest and its rollup document."""
    return ((F.col("name") == F.concat("dataset", F.lit(".checksums")))
            | (F.col("name") == F.concat("dataset", F.lit(".daml"))))


def extra_files(files: DataFrame) -> DataFrame:
    """Files of no known kind, except the dataset's manifest and rollup document."""
    return _folder_findings(_of_kind(files, EXTRA).filter(~_own_extra()), "extra_files", "unexpected file")


def folder_checks(files: DataFrame, datasets: DataFrame | None = None,
                  checks: tuple[str, ...] = ("docs_without_table", "tables_without_doc", "notes_check", "extra_files")
                  ) -> DataFrame:
    """The checks on a folder's files together: ``dataset, name, check, severity, message``.

    Two reads of the inventory, whatever the checks: files of one stem are a group of at most four
    (document, table, notes, anything else), and a folder is one row of counts.
    """
    kind, dataset = F.col("kind"), F.col("dataset")
    own = (kind == NOTES) & (F.col("name") == F.concat("dataset", F.lit(".md")))
    known = _own_extra()

    def name_of(what: str, also=F.lit(True)) -> Column:
        return F.max(F.when((kind == what) & also, F.col("name")))

    def about(name: Column, found: Column, late: bool = False) -> Column:
        return F.transform(found, lambda f: F.struct(name.alias("name"), f.alias("f"), F.lit(late).alias("late")))

    def alone(name: str, partner: Column, check: str, message: str) -> Column:
        return about(F.col(name), when_found(F.col(name).isNotNull() & partner.isNull(), check, FAIL, message),
                     check == "notes_check")

    stems = files.groupBy("dataset", "stem").agg(
        name_of(DOCUMENT).alias("document"), name_of(TABLE).alias("table"), name_of(NOTES, ~own).alias("notes"),
        F.collect_set(F.when((kind == EXTRA) & ~known, F.col("name"))).alias("extras"))
    of_files = {
        "docs_without_table": alone("document", F.col("table"), "docs_without_table", f"no .{TABLE} of the same name"),
        "tables_without_doc": alone("table", F.col("document"), "tables_without_doc", f"no .{DOCUMENT} of the same name"),
        "notes_check": alone("notes", F.col("table"), "notes_check", f"no .{TABLE} of the same name"),
        "extra_files": F.transform("extras", lambda n: F.struct(
            n.alias("name"), finding("extra_files", FAIL, "unexpected file").alias("f"), F.lit(False).alias("late")))}
    rows = stems.select("dataset", F.inline_outer(F.concat(*[of_files[c] for c in checks]))).filter(F.col("f").isNotNull())

    counts = files.groupBy("dataset").agg(
        F.count_if(kind == DOCUMENT).alias("documents"), F.count_if(kind == TABLE).alias("tables"), F.count_if(own).alias("notes"))
    if datasets is not None:
        nothing = datasets.select("dataset", *[F.lit(0).cast("bigint").alias(c) for c in ("documents", "tables", "notes")])
        counts = counts.unionByName(nothing).groupBy("dataset").agg(*[F.max(c).alias(c) for c in ("documents", "tables", "notes")])
    of_folders = {
        "docs_without_table": ("documents", F.lit(""), f"no .{DOCUMENT} files"),
        "tables_without_doc": ("tables", F.lit(""), f"no .{TABLE} files"),
        "notes_check": ("notes", F.concat(dataset, F.lit(".md")), "notes of the dataset are missing")}
    whole = [about(name, when_found(F.col(count) == 0, check, FAIL, message))
             for check, (count, name, message) in of_folders.items() if check in checks]
    folders = counts.select("dataset", F.inline_outer(F.concat(*whole) if whole else F.lit(None).cast(
        f"array<struct<name:string,f:{FINDING_TYPE},late:boolean>>"))).filter(F.col("f").isNotNull())
    # Notes without a table count only in a folder that has its own.
    has_notes = counts.select("dataset", (F.col("notes") > 0).alias("complete"))
    kept = rows.join(by_shuffle(has_notes), "dataset", "left").filter(~F.col("late") | F.col("complete"))
    return folders.select("dataset", "name", "f.*").unionByName(kept.select("dataset", "name", "f.*"))


def dataset_name_check(docs: DataFrame) -> DataFrame:
    """Documents (``dataset, name, declared_dataset``) that name another dataset."""
    wrong = docs.filter(~F.col("declared_dataset").eqNullSafe(F.col("dataset")))
    return _folder_findings(wrong, "dataset_name_check", "names another dataset")


# --- manifests ---------------------------------------------------------------

def manifest_compare(expected: DataFrame, computed: DataFrame) -> DataFrame:
    """Compare manifests ``dataset, name, sha1``: ``dataset, name, status`` for every
    missing, extra or mismatched file.  The manifest does not list itself."""
    actual = computed.filter(F.col("name") != F.concat("dataset", F.lit(".checksums")))
    joined = (expected.select("dataset", "name", F.col("sha1").alias("want"), F.lit(True).alias("e"))
              .join(actual.select("dataset", "name", F.col("sha1").alias("have"),
                                  F.lit(True).alias("c")), ["dataset", "name"], "full_outer"))
    status = (F.when(F.col("c").isNull(), "missing")
              .when(F.col("e").isNull(), "extra")
              .when(~F.col("want").eqNullSafe(F.col("have")), "mismatched"))
    return joined.select("dataset", "name", status.alias("status")).filter("status is not null")


def hash_fill(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """The stored hash of a file where there is one, else the computed one."""
    have = computed.select("dataset", "name", F.col("sha1").alias("__computed"))
    return stored.join(have, ["dataset", "name"], "left").select(
        "dataset", "name", F.coalesce("sha1", "__computed").alias("sha1"))


def submission_bundle(listing: DataFrame, problems: DataFrame) -> DataFrame:
    """Every file of the datasets whose manifest is clean, with whether it is sent
    itself (tables are only listed)."""
    clean = listing.join(problems.select("dataset").distinct(), "dataset", "left_anti")
    return clean.withColumn("is_sent", ~F.endswith("name", F.lit(".parquet")))
