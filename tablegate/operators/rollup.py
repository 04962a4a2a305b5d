"""Dataset rollup documents built from table documents.

Input rows: ``dataset, file, survey, table, version, author, coauthors``.  A dataset
may hold any number of tables, so its lists stay in long form, one row per item
with the keys that order them; nothing gathers a dataset into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate import rules as R
from tablegate.functions import kinds as K
from tablegate.functions.findings import (
    FAIL, FINDING_TYPE, all_of, explode_findings, explode_once, no_findings, when_found,
)
from tablegate.operators import documents as D
from tablegate.sources.store import by_shuffle


def rollup_survey(docs: DataFrame, keys=("dataset",), default: str = R.DEFAULT_SURVEY) -> DataFrame:
    """The one survey all documents share, else the default."""
    shared = (F.min("survey") == F.max("survey")) & (F.count("survey") == F.count(F.lit(1)))
    return docs.groupBy(*keys).agg(
        F.when(shared, F.min("survey")).otherwise(default).alias("survey"))


def rollup_dataset(docs: DataFrame, declared: str = "declared_dataset") -> DataFrame:
    """The one dataset name all documents of a folder declare; null when they differ."""
    shared = F.min(declared) == F.max(declared)
    complete = F.count(declared) == F.count(F.lit(1))
    return docs.groupBy("dataset").agg(
        F.when(shared & complete, F.min(declared)).alias("declared_dataset"),
        F.coalesce(shared & complete, F.lit(False)).alias("is_single"))


def rollup_author(docs: DataFrame) -> DataFrame:
    """Most frequent author; of equals the one whose first document comes first."""
    counted = docs.groupBy("dataset", "author").agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file"))
    best = counted.groupBy("dataset").agg(
        F.min_by("author", F.struct((-F.col("n")).alias("n"), F.col("first_file"))).alias("author"))
    return best


top1_author = rollup_author


def rollup_coauthors(docs: DataFrame) -> DataFrame:
    """Distinct coauthors with the place of their first mention (``first_file``,
    ``first_pos``), which is their order."""
    rows = explode_once(docs, ["dataset", "file"], F.col("coauthors"), "pos", "coauthor")
    first = rows.groupBy("dataset", "coauthor").agg(F.min(F.struct("file", "pos")).alias("at"))
    return first.select("dataset", "coauthor", F.col("at.file").alias("first_file"),
                        F.col("at.pos").alias("first_pos"))


def rollup_tables(docs: DataFrame) -> DataFrame:
    return docs.select("dataset", "file", F.col("table").alias("name"), "version")


SECTION = R.ROLLUP_KEYS.index


def build_rollup(docs: DataFrame, releases: DataFrame, date: str,
                 license_name: str = R.DEFAULT_LICENSE) -> DataFrame:
    """Rollup documents in long form: ``dataset, section, key, order_file, order_pos,
    value, version``.  ``section`` follows the key order of the document; keys without
    a value are left out, an empty description stays to be filled in.

    A document's table is a line as it stands.  Survey, author and coauthors leave as rows; equal ones are counted,
    and a second grouping chooses a dataset's survey and author among them.  Counting sorts a task's rows (the place
    of a first mention is a text), so the documents are dealt out first, whatever their files.
    """
    nothing = F.lit(None).cast("int")

    def item(key, value, pos=F.lit(0)):
        return F.struct(F.lit(SECTION(key)).alias("section"), value.alias("value"), pos.cast("int").alias("pos"))

    single = F.array(item("survey", F.col("survey")), item("author", F.col("author")))
    listed = F.filter(F.transform("coauthors", lambda c, i: item("coauthors", c, i)), lambda x: x["value"].isNotNull())
    items = F.concat(single, F.coalesce(listed, F.slice(single, 1, 0)))
    dealt = docs.select("dataset", "file", "survey", "author", "coauthors").repartition("dataset", "file")
    rows = dealt.select("dataset", "file", F.inline_outer(items)).filter(F.col("section").isNotNull())
    counted = rows.groupBy("dataset", "section", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "pos")).alias("at"))
    one = F.col("section").isin(SECTION("survey"), SECTION("author"))
    # The most frequent value, of equals the first; of lists every value is a group of its own.
    chosen = counted.groupBy("dataset", "section", F.when(~one, F.struct("value")).alias("each")).agg(
        F.min_by(F.struct("value", "at"), F.struct((-F.col("n")).alias("n"), F.col("at.file").alias("file"))).alias("best"),
        F.count(F.lit(1)).alias("different"))
    known = releases.select("dataset", F.lit(SECTION("survey")).alias("section"), "next_release")
    joined = chosen.join(by_shuffle(known), ["dataset", "section"], "left")

    def line(key, value, file=F.lit(""), pos=F.lit(0), version=nothing):
        return F.struct(F.lit(SECTION(key)).alias("section"), F.lit(key).alias("key"), file.alias("order_file"),
                        pos.alias("order_pos"), value.cast("string").alias("value"), version.alias("version"))

    value, place = F.col("best.value"), F.col("best.at")
    survey = F.when(F.col("different") == 1, F.coalesce(value, F.lit(R.DEFAULT_SURVEY))).otherwise(R.DEFAULT_SURVEY)
    head = F.array(
        line("survey", survey), line("dataset", F.col("dataset")), line("version", F.coalesce("next_release", F.lit(1))),
        line("date", F.lit(date)), line("description", F.lit(None)), line("license", F.lit(license_name)))
    lines = (F.when(F.col("section") == SECTION("survey"), head)
             .when(F.col("section") == SECTION("author"), F.array(line("author", value)))
             .otherwise(F.array(line("coauthors", value, place["file"], place["pos"]))))
    tables = docs.select("dataset", F.inline(F.array(line(
        "tables", F.col("table"), F.col("file"), version=F.col("version").cast("int")))))
    return joined.select("dataset", F.inline(lines)).unionByName(tables)


# --- checks on an existing rollup document -----------------------------------

def dataset_match() -> Column:
    """The document's dataset is its folder's name (column ``dataset``)."""
    actual = F.when(D.kind_of("dataset") == K.STRING, K.as_text(D.value("dataset")))
    return all_of(
        D.required_kind("dataset", K.STRING, "rollup_dataset_match"),
        when_found(actual != F.col("dataset"), "rollup_dataset_match", FAIL,
                   F.concat(F.lit("dataset should be "), F.col("dataset"))))


def version_match() -> Column:
    """The document's version is the next release (column ``next_release``, null for a first one)."""
    expected = F.coalesce("next_release", F.lit(1))
    version = F.when(D.kind_of("version") == K.INTEGER,
                     F.try_variant_get(D.value("version"), "$", "bigint"))
    return all_of(
        D.required_kind("version", K.INTEGER, "rollup_version_match"),
        when_found(version != expected, "rollup_version_match", FAIL,
                   F.concat(F.lit("version should be "), expected)))


def rollup_dataset_match(opened: DataFrame, keys=("file",)) -> DataFrame:
    return explode_findings(opened, list(keys), dataset_match())


def rollup_version_match(opened: DataFrame, releases: DataFrame, keys=("file",)) -> DataFrame:
    joined = opened.join(by_shuffle(releases.select("dataset", "next_release")), "dataset", "left")
    return explode_findings(joined, list(keys), version_match())


def listed_tables(opened: DataFrame) -> DataFrame:
    """Tables a rollup document lists: ``dataset, name, version``; entries without a
    name are skipped, a repeated name counts once with its last version."""
    entries = explode_once(opened, ["dataset"], K.as_list(D.value("tables")), "pos", "item")
    named = entries.select(
        "dataset", "pos", K.as_text(K.member(F.col("item"), "name")).alias("name"),
        F.try_variant_get(K.member(F.col("item"), "version"), "$", "int").alias("version"))
    return (named.filter(F.col("name").isNotNull()).groupBy("dataset", "name")
            .agg(F.max_by("version", "pos").alias("version")))


src_rollup_tables = listed_tables


def _tables_differ() -> Column:
    """Findings on one table of a rollup (``listed``, there if ``l``) and of the documents (``declared``, ``d``)."""
    check = "rollup_tables_check"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    both = F.col("l").isNotNull() & F.col("d").isNotNull()
    return all_of(
        when_found(F.col("l").isNull(), check, FAIL, "not in the rollup"),
        when_found(F.col("d").isNull(), check, FAIL, "in no table document"),
        when_found(both & ~F.col("listed").eqNullSafe(F.col("declared")), check, FAIL,
                   F.concat(F.lit("version "), text("listed"), F.lit(" should be "), text("declared"))))


def rollup_tables_check(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """Tables of the rollup against those of the documents: absent on one side, or
    of another version.  Both are ``dataset, name, version``."""
    a = listed.select("dataset", "name", F.col("version").alias("listed"), F.lit(True).alias("l"))
    b = docs.select("dataset", "name", F.col("version").alias("declared"), F.lit(True).alias("d"))
    return explode_findings(a.join(b, ["dataset", "name"], "full_outer"), ["dataset", "name"], _tables_differ())


def rollup_row_checks() -> list:
    """The rollup checks that need the document alone."""
    return [
        D.survey(), D.author(), D.coauthors(), D.date(), D.description(), D.license_name(),
        D.required("tables", "rollup_tables_check"), D.no_extra_keys(R.ROLLUP_KEYS),
        D.empty_optionals(R.ROLLUP_REQUIRED), D.key_order(R.ROLLUP_KEYS),
    ]


def validate_rollup(rollups: DataFrame, tables: DataFrame, releases: DataFrame) -> DataFrame:
    """The rollup suite over ``dataset, file, raw``: ``dataset, subject, check,
    severity, message``.  ``tables`` holds ``dataset, name, version`` of the documents.

    A document is opened once: its own findings and the tables it lists leave as rows, which meet the
    documents' tables in one grouping.
    """
    none, no = F.lit(None), F.lit(None).cast("boolean")

    def row(subject, found=no_findings(), pos=none, listed=none, declared=none, l=no, d=no):
        return F.struct(subject.alias("subject"), found.alias("found"), pos.cast("int").alias("pos"), listed.cast("int").alias("listed"),
                        declared.cast("int").alias("declared"), l.alias("l"), d.alias("d"))

    opened = D.open_documents(rollups).join(by_shuffle(releases.select("dataset", "next_release")), "dataset", "left")
    own = all_of(*rollup_row_checks(), dataset_match(), version_match())
    names = F.filter(F.transform(K.as_list(D.value("tables")), lambda t, i: row(
        K.as_text(K.member(t, "name")), pos=i, l=F.lit(True),
        listed=F.try_variant_get(K.member(t, "version"), "$", "int"))), lambda r: r["subject"].isNotNull())
    rows = opened.select("dataset", F.inline(F.concat(
        F.array(row(F.col("file"), found=own)), F.coalesce(names, F.array().cast(f"array<{ROW_TYPE}>")))))
    declared = tables.join(by_shuffle(rollups.select("dataset")), "dataset", "left_semi").select(
        "dataset", F.inline(F.array(row(F.col("name"), declared=F.col("version"), d=F.lit(True)))))
    is_table = F.coalesce("l", "d", F.lit(False))
    met = rows.unionByName(declared).groupBy("dataset", "subject", is_table.alias("is_table")).agg(
        F.flatten(F.collect_list("found")).alias("found"), F.max_by("listed", "pos").alias("listed"),
        F.max("declared").alias("declared"), F.bool_or("l").alias("l"), F.bool_or("d").alias("d"))
    return explode_findings(met, ["dataset", "subject"], F.when(F.col("is_table"), _tables_differ()).otherwise(F.col("found")))


ROW_TYPE = (f"struct<subject:string,found:array<{FINDING_TYPE}>,pos:int,listed:int,declared:int,l:boolean,d:boolean>")
