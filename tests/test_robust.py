"""Odd inputs that must not stop a job: documents, bounds, folders, word lists, types."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablegate.operators import catalog, documents as D, profile, reconcile, report, values
from tablegate.sources import documents as S
from tablegate.sources import folders as folders_source
from tablegate.sources import inventory, vocabulary


def test_odd_documents_keep_their_row(spark):
    texts = {"bool": "a: !!bool maybe", "int": "a: !!int ''", "self": "a: &x [*x]", "list": "- a", "text": "a: 1",
             "key": "? [1, 2]\n: b", "empty": ""}
    frame = spark.createDataFrame(list(texts.items()), "file string, text string")
    found = {r.file: r for r in S.parse_documents(frame).collect()}
    assert set(found) == set(texts)
    assert found["text"].raw == '{"a": 1}' and found["text"].parse_error is None
    for odd in ("bool", "int", "self", "list", "empty"):
        assert found[odd].raw is None and found[odd].parse_error


def test_infinite_bounds_are_numbers(spark):
    text = "table: t\nfields:\n- {name: a, data_type: float64, qc: {min: 0.0, max: .inf}}\n" \
           "- {name: b, data_type: float64, qc: {min: -.inf, max: .nan}}\n"
    docs = S.parse_documents(spark.createDataFrame([("f", text)], "file string, text string"))
    assert json.loads(docs.first().raw)["table"] == "t"
    opened = D.open_fields(D.open_documents(docs))
    assert opened.select(F.size(D.fields_qc())).first()[0] == 0
    rows = {r.name: (r.qc_min, r.qc_max) for r in D.field_rows(opened).collect()}
    assert rows == {"a": ("0", "Infinity"), "b": ("-Infinity", "NaN")}


@pytest.mark.parametrize("low, high, fits", [
    ("0", "Infinity", True), ("-Infinity", "Infinity", True), ("true", "9", True), ("0", "true", False),
    ("abc", "9", False), ("0", "1" + "0" * 40, True), ("0", "NaN", True), ("NaN", "9", False), ("0", "9", True),
    ("0", '"9"', False)])
def test_bounds_of_any_kind(spark, low, high, fits):
    for dtype in ("int", "double"):
        df = spark.range(1, 4).select(F.col("id").cast(dtype).alias("x"))
        found = profile.profile_table(df, "t").select(
            values.profile_in_range(F.lit(low), F.lit(high), "both").alias("ok")).first().ok
        assert found is fits


def test_wide_tables_are_scanned_once(spark, tmp_path):
    spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(120)]).write.parquet(f"{tmp_path}/wide")
    found = profile.profile_table(spark.read.parquet(f"{tmp_path}/wide"), "wide")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.where("min_value = pos AND max_value = pos + 2").count() == 120


def test_folders_empty_nested_and_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders_source, "SPLIT_ENTRIES", 2)
    for name in ("none", "some/inner"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("a.maml", "a.parquet", "some.md", "empty.md"):
        (tmp_path / "some" / name).write_text("" if name == "empty.md" else "x")
    folders = [f"file://{tmp_path}/none", f"file://{tmp_path}/some"]
    files = inventory.inventory(spark, folders)
    assert {(r.name, r.kind, r.length) for r in files.collect()} == {
        ("a.maml", "maml", 1), ("a.parquet", "parquet", 1), ("some.md", "md", 1), ("empty.md", "md", 0),
        ("inner", "extra", None)}
    assert [r["name"] for r in reconcile.extra_files(files).collect()] == ["inner"]
    datasets = inventory.datasets_of(spark, folders)
    found = [c(files, datasets) for c in (reconcile.docs_without_table, reconcile.tables_without_doc, reconcile.notes_check)]
    assert [[r.dataset for r in f.collect() if r.dataset == "none"] for f in found] == [["none"]] * 3
    gate = report.dataset_gate(datasets, found[0].unionByName(found[1]).select("dataset", "severity"))
    assert {r.dataset: r.passes for r in gate.collect()} == {"none": False, "some": True}
    assert inventory.file_listing(spark, folders).count() == 4


def test_the_last_line_of_a_word_holds(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# list\nP | Meta.ID | zeta\nS | meta.id | alpha\r\n")
    row = vocabulary.read_vocabulary(spark, f"{tmp_path}/words.txt").first()
    assert (row.name, row.canonical, row.descr) == ("meta.id", "meta.id", "alpha")
    assert row.is_primary and row.is_secondary


def test_unsigned_columns_are_not_accepted(spark, tmp_path):
    table = pa.table({"u8": np.zeros(1, "u1"), "u16": np.zeros(1, "u2"), "i16": np.zeros(1, "i2"), "u64": np.zeros(1, "u8")})
    pq.write_table(table, tmp_path / "t.parquet")
    columns = catalog.catalog(spark, {"t": spark.read.parquet(f"{tmp_path}/t.parquet")})
    assert {r.column: r.dtype for r in columns.collect()} == {"u8": "uint8", "u16": "uint16", "i16": "int16", "u64": "uint64"}
    assert {r.column for r in catalog.type_support_check(columns).collect()} == {"u8", "u16", "u64"}


def test_set_fields(spark):
    fields = spark.createDataFrame([("t", "a", "m"), ("t", "b", "s")], "table string, column string, unit string")

    def updated(*rows):
        updates = spark.createDataFrame(list(rows), "table string, column string, value string")
        return {r.column: r.unit for r in D.set_fields(fields, updates, "unit").collect()}

    assert updated(("t", "a", "km"), ("t", "a", "km"), ("t", "b", None)) == {"a": "km", "b": None}
    with pytest.raises(Exception, match="unknown column z"):
        updated(("t", "z", "km"))


def test_lint_offences_reject_a_document(spark):
    frame = spark.createDataFrame([("good", "a: 1"), ("bad", "a:1\nb: 2")], "file string, text string")
    found = {r.file: r for r in S.reject_offences(frame).collect()}
    assert found["good"].raw and not found["good"].parse_error
    assert found["bad"].raw is None and found["bad"].parse_error
