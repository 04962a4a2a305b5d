"""Rule files, footers and the sentinel scan on real files."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablegate.operators import catalog, names, profile, reconcile, values
from tablegate.rules import DEFAULT_RULES
from tablegate.sources import rulefiles

PROTECTED = """# words
mass:
  common_mistakes: [mas, weight]
  unit: [kg]
  ucd: [phys.mass]
size: [1]
angle:
  common_mistakes: ang
  unit: [deg]
  ucd: [pos.ang]
time:
  common_mistakes: []
  ucd: [time]
"""


def test_rule_files(spark, tmp_path):
    for name, text in {"protected_words.yaml": PROTECTED, "filters.yaml": "u_X:\n  secondary_ucd: em.opt\nbad: 3\n",
                       "exceptions.yaml": "uberKEY: {ucd: meta.id, unit: '--'}\nnone: {unit: m}\n", "ucd_rules.yaml": "namespaces: [ivoa, 7, other]\n",
                       "more.yaml": "a: 1\n"}.items():
        (tmp_path / name).write_text(text)
    rows = rulefiles.read_rules(spark, f"{tmp_path}/*.yaml").orderBy("file", "pos").collect()
    found = [(r.kind, r.pos, r.name, r.error) for r in rows]
    assert found == [
        ("exceptions", 0, "uberKEY", None), ("exceptions", 1, "none", "ucd is missing"),
        ("filters", 0, "u_X", None), ("filters", 1, "bad", "must be mapping"),
        (None, 0, None, "no rule file of this name"),
        ("protected", 0, "mass", None), ("protected", 1, "size", "must be mapping"),
        ("protected", 2, "angle", "common_mistakes must be list of strings"), ("protected", 3, "time", "unit is missing"),
        ("namespaces", 0, "ivoa", None), ("namespaces", 1, "7", "must be string"), ("namespaces", 2, "other", None)]
    entries = rulefiles.read_rules(spark, f"{tmp_path}/*.yaml")
    with pytest.raises(ValueError, match="bad: must be mapping"):
        rulefiles.rule_book(entries)
    book = rulefiles.rule_book(entries, strict=False)
    assert [(w.name, w.mistakes, w.units, w.tags) for w in book.protected] == [("mass", ("mas", "weight"), ("kg",), ("phys.mass",))]
    assert [(f.name, f.inverse, f.tag) for f in book.filters] == [("u_X", "X_u", "em.opt")]
    assert book.namespaces == ("ivoa", "other") and book.banned == DEFAULT_RULES.banned
    given = spark.createDataFrame([("X_u",), ("weight",), ("uberkey",)], "name string")
    assert {(r.name, r.check) for r in names.validate_column_names(given, "name", book).collect()} >= {
        ("X_u", "name_filter_inverse"), ("weight", "name_protected"), ("uberkey", "name_exception_case")}


def test_a_rule_file_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "filters.yaml").write_text("a: [1,\n")
    row = rulefiles.read_rules(spark, f"{tmp_path}/*.yaml").first()
    assert row.kind == "filters" and row["name"] is None and "Error" in row.error


def written(path, **columns):
    pq.write_table(pa.table(columns), path)


def test_footers_of_all_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    written(tmp_path / "t/a.parquet", x=np.zeros(2, "i4"), u=np.zeros(2, "u2"), only=np.zeros(2))
    written(tmp_path / "t/b.parquet", x=np.zeros(2, "i8"), u=np.zeros(2, "u2"))
    written(tmp_path / "one.parquet", x=np.zeros(2, "f4"), s=["a", "b"], b=[True, False])
    tables = {"t": spark.read.parquet(f"{tmp_path}/t"), "one": spark.read.parquet(f"{tmp_path}/one.parquet")}
    footers = catalog.file_columns(spark, tables)
    assert {(r.table, r.file[-9:], r.pos, r.column, r.dtype) for r in footers.collect()} == {
        ("t", "a.parquet", 0, "x", "int32"), ("t", "a.parquet", 1, "u", "uint16"), ("t", "a.parquet", 2, "only", "float64"),
        ("t", "b.parquet", 0, "x", "int64"), ("t", "b.parquet", 1, "u", "uint16"), ("one", "e.parquet", 0, "x", "float32"),
        ("one", "e.parquet", 1, "s", "string"), ("one", "e.parquet", 2, "b", "boolean")}
    assert {(r.table, r.column, r.message) for r in catalog.file_schema_check(footers).collect()} == {
        ("t", "x", "types differ between files: int32, int64"), ("t", "only", "in 1 of 2 files")}


def test_unsigned_columns_fail_on_profiles(spark, tmp_path):
    written(tmp_path / "t.parquet", u=np.zeros(2, "u2"), i=np.zeros(2, "i4"))
    tables = {"t": spark.read.parquet(f"{tmp_path}/t.parquet")}
    fields = spark.createDataFrame([("t", "u", "int32"), ("t", "i", "int32")], "table string, column string, data_type string")
    fields = fields.withColumn("qc_min", F.lit(None).cast("string")).withColumn("qc_max", F.lit(None).cast("string"))
    profiles = profile.profile_tables(tables, footers=catalog.file_columns(spark, tables))
    assert [(r.column, r.check, r.message) for r in reconcile.validate_consistency(profiles, fields).collect()] == [
        ("u", "column_type_check", "declared int32, is uint16")]


def test_profiles_of_many_tables_in_one(spark):
    rows = [(d, t, float(k), None if k == 2 else "-999" if (d, t) == ("a", "y") else "z") for d, t in (("a", "x"), ("a", "y"), ("b", "x")) for k in range(4)]
    df = spark.createDataFrame(rows, "dataset string, table string, ra double, note string")
    found = {(r.dataset, r.table, r.column): r for r in profile.profile_groups(df, ["dataset", "table"]).collect()}
    assert len(found) == 6
    for (d, t, c), row in found.items():
        one = profile.profile_table(df.where(f"dataset = '{d}' AND table = '{t}'").drop("dataset", "table"), t).where(f"column = '{c}'").first()
        assert {k: row[k] for k in one.asDict() if k != "table"} == {k: v for k, v in one.asDict().items() if k != "table"}
    checks = {(r.dataset, r.table, r.column, r.check) for r in values.validate_groups(df, ["dataset", "table"], "table").collect()}
    assert ("a", "y", "note", "sentinel_scan") in checks and all(c[3] != "sentinel_scan" or c[:2] == ("a", "y") for c in checks)


def test_clean_row_groups_are_not_read(spark, tmp_path):
    n = 40_000
    ids = np.arange(n)
    for name, value in (("clean", ids % 7 + 0.5), ("dirty", np.where(ids == n - 1, -999, ids % 7 + 0.5))):
        pq.write_table(pa.table({"x": value, "s": [f"t{i % 9}" for i in ids], "i": ids.astype("i4"), "n": np.full(n, np.nan)}),
                       tmp_path / f"{name}.parquet", row_group_size=10_000)

    def scanned(table):
        found = values.sentinel_scan(spark.read.parquet(f"{tmp_path}/{table}.parquet"), table)
        rows = {r.column: r.has_sentinel for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan()
        while plan.children().size() or plan.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec", "ShuffleQueryStageExec"):
            name = plan.getClass().getSimpleName()
            plan = plan.executedPlan() if name.startswith("Adaptive") else plan.plan() if name.endswith("StageExec") else plan.children().head()
        return rows, plan.metrics().apply("numOutputRows").value()

    assert scanned("clean") == ({"x": False, "s": False, "i": False, "n": False}, 0)
    rows, read = scanned("dirty")
    assert rows == {"x": True, "s": False, "i": False, "n": False} and 0 < read <= 10_000
