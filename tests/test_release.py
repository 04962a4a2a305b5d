"""Release folders end to end: listings, named files, and the two passes of the release check."""

import hashlib
import os
from datetime import datetime, timezone

import pytest
import yaml
from pyspark.sql import functions as F

from tablegate.operators import history
from tablegate.plans import suites
from tablegate.sources import documents as S
from tablegate.sources import folders, inventory, manifests, sinks, vocabulary

DOC = {
    "survey": "WAVES", "dataset": "stars", "table": "bright", "version": 1, "date": "2024-05-06",
    "author": "A B <a@example.com>", "description": "Bright stars", "license": "MIT", "MAML_version": 1.1,
    "fields": [{"name": "ra", "unit": "deg", "info": "x", "ucd": "pos.eq", "data_type": "float64", "qc": {"min": 0.0, "max": 10.0}},
               {"name": "star_id", "unit": "--", "info": "x", "ucd": "meta.id", "data_type": "int64"}]}
CONTENTS = {"a.maml": b"a: 1\n", "a.parquet": b"x" * 70_000, "none.md": b"", "_hidden.txt": b"h", ".dot": b"d"}


def words(spark):
    return vocabulary.vocabulary(spark.createDataFrame(
        [("P", "pos.eq", ""), ("P", "meta.id", "")], "type string, name string, descr string"))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "stars"
    (root / "inner").mkdir(parents=True)
    for name, content in CONTENTS.items():
        (root / name).write_bytes(content)
        os.utime(root / name, ns=(0, 1_700_000_000_123_456_000))
    return str(root)


def test_every_column_of_a_listing(spark, folder, monkeypatch):
    monkeypatch.setattr(folders, "SPLIT_BYTES", 1000)
    rows = {r.file_name: r for r in inventory.file_listing(spark, [folder]).collect()}
    assert set(rows) == set(CONTENTS)
    for name, content in CONTENTS.items():
        row = rows[name]
        assert row.sha1 == hashlib.sha1(content).hexdigest() and row.directory == folder + "/"
        assert row.modified == datetime.fromtimestamp(1_700_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        micros, length = (int(x, 16) for x in row.etag.split("-"))
        assert (micros, length) == (1_700_000_000_123_456, len(content))
    plan = inventory.file_listing(spark, [folder])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("release_folders") == 1 and "Exchange" not in plan


def test_splits_are_balanced(folder, monkeypatch):
    monkeypatch.setattr(folders, "SPLIT_BYTES", 4)
    splits = folders.FolderReader([folder], True).partitions()
    assert sum(len(s.held) for s in splits) == len(CONTENTS) + 1 and len(splits) == 3
    assert len(folders.FolderReader([folder], False).partitions()) == 1


def test_a_file_system_that_only_spark_opens(spark, folder, monkeypatch):
    monkeypatch.setattr(folders, "readable", lambda path: False)
    rows = {r["name"]: r for r in inventory.hashed_inventory(spark, [f"file://{folder}"]).collect()}
    assert set(rows) == {*CONTENTS, "inner"}
    for name, content in CONTENTS.items():
        assert rows[name].length == len(content) and rows[name].kind == inventory_kind(name)
        assert rows[name].sha1 == (None if name[0] in "._" else hashlib.sha1(content).hexdigest())
        assert rows[name].modified.timestamp() == pytest.approx(1_700_000_000.123, abs=0.001)
    assert rows["inner"].length is None and rows["inner"].kind == "extra"
    assert {r["name"] for r in inventory.inventory(spark, [f"file://{folder}"]).collect()} == set(rows)


def inventory_kind(name):
    ending = name.rsplit(".", 1)[-1]
    return ending if ending in ("maml", "parquet", "md") else "extra"


def test_manifests_are_read_as_written(spark, tmp_path):
    given = [(d, f"{n:04}.parquet", hashlib.sha1(f"{d}{n}".encode()).hexdigest())
             for d, count in (("stars", 3000), ("odd name%=é", 2), ("001", 1)) for n in range(count)]
    hashes = spark.createDataFrame(given, "dataset string, name string, sha1 string")
    for _ in range(2):  # the second replaces the first
        sinks.write_manifests(hashes.repartition(7), str(tmp_path))
        assert sorted(map(tuple, manifests.read_manifests(spark, f"{tmp_path}/*/*.checksums").select(
            "dataset", "name", "sha1").collect())) == sorted(given)
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()) == sorted(
        f"{d}/{d}.checksums" for d in {g[0] for g in given})
    text = (tmp_path / "stars/stars.checksums").read_text().splitlines()
    assert len(text) == 3003 and text[3:] == sorted(text[3:]) and all(x.startswith("#") for x in text[:3])
    with pytest.raises(ValueError):
        sinks.write_manifests(spark.createDataFrame([("a/b", "n", "h")], "dataset string, name string, sha1 string"), str(tmp_path))
    assert not list(tmp_path.glob("_*"))


def check(spark, root, checksums=(), versions=()):
    given, hashes = suites.read_release(
        spark, [str(root / "stars"), str(root / "bare")],
        spark.createDataFrame([("stars", 2)], "dataset string, next_release int"),
        spark.createDataFrame(list(checksums), "dataset string, release int, file string, sha1 string"),
        spark.createDataFrame(list(versions), "dataset string, release int, table string, table_version int"), words(spark))
    findings, out = suites.check_release(given, hashes, "2024-06-01")
    return findings, out, {r.dataset: r.passes for r in out.gate.collect()}


def test_a_release_in_two_passes(spark, tmp_path):
    stars = tmp_path / "stars"
    stars.mkdir()
    (tmp_path / "bare").mkdir()
    table = spark.range(5).select((F.col("id") * 2.0).alias("ra"), F.col("id").alias("star_id"))
    table.toPandas().to_parquet(stars / "bright.parquet")
    (stars / "stars.md").write_text("notes")
    (stars / "bright.maml").write_text(yaml.safe_dump(DOC | {"version": "one"}, sort_keys=False))

    findings, out, gate = check(spark, tmp_path)
    assert gate == {"stars": False, "bare": False} and out.rollups.count() == 0
    found = {(r.table, r.suite, r.check) for r in findings.where("dataset = 'stars' AND severity = 2").collect()}
    assert found == {("bright", "document", "doc_version_int"), ("bright", "consistency", "document_failed"),
                     (None, "folder", "version_check")}
    assert {r.check for r in findings.where("dataset = 'bare'").collect()} == {"docs_without_table", "tables_without_doc", "notes_check"}

    # A column out of its declared range, then a right one: the first pass writes the rollup document.
    narrow = [DOC["fields"][0] | {"qc": {"min": 0.0, "max": 7.5}}, DOC["fields"][1]]
    (stars / "bright.maml").write_text(yaml.safe_dump(DOC | {"fields": narrow}, sort_keys=False))
    findings, _, gate = check(spark, tmp_path)
    assert not gate["stars"] and [(r.suite, r.subject, r.check) for r in findings.where("dataset = 'stars'").collect()] == [
        ("consistency", "ra", "declared_range_check")]
    (stars / "bright.maml").write_text(yaml.safe_dump(DOC, sort_keys=False))
    _, out, gate = check(spark, tmp_path)
    assert gate["stars"] and out.manifests.count() == 0
    sinks.write_rollups(out.rollups, str(tmp_path))
    daml = stars / "stars.daml"
    assert yaml.safe_load(daml.read_text())["tables"] == [{"name": "bright", "version": 1}]

    # Its description is still to be filled in; after that the second pass writes the manifest.
    findings, _, gate = check(spark, tmp_path)
    assert not gate["stars"] and {r.check for r in findings.where("dataset = 'stars'").collect()} == {"doc_description"}
    daml.write_text(daml.read_text().replace("description:", "description: Bright stars"))
    _, out, gate = check(spark, tmp_path)
    assert gate["stars"] and out.rollups.count() == 0
    sinks.write_manifest_lines(out.manifests, str(tmp_path))
    assert {r["name"] for r in manifests.read_manifests(spark, f"{stars}/*.checksums").collect()} == {
        "bright.maml", "bright.parquet", "stars.daml", "stars.md"}

    # Published as release 1 with other content: it needs the next version.
    findings = check(spark, tmp_path, [("stars", 1, "bright.parquet", "other")], [("stars", 1, "bright", 1)])[0]
    assert [r.message for r in findings.where("check = 'version_check'").collect()] == ["version 1 should be 2"]


def test_history_by_file_and_table(spark):
    local = spark.createDataFrame(
        [("d", "t", "t.parquet", "h3"), ("d", "renamed_table", "u.parquet", "x"), ("d", "v", "renamed_file.parquet", "v"),
         ("d", "w", "w.parquet", None), ("d", "two", "a.parquet", "new"), ("d", "two", "b.parquet", "b")],
        "dataset string, table string, file string, sha1 string")
    checksums = spark.createDataFrame(
        [("d", 1, "t.parquet", "h1"), ("d", 3, "t.parquet", "h3"), ("d", 2, "u.parquet", "x"), ("d", 2, "v.parquet", "v"),
         ("d", 4, "w.parquet", "w4"), ("d", 5, "w.parquet", "w5"), ("d", 1, "a.parquet", "a"), ("d", 1, "b.parquet", "b")],
        "dataset string, release int, file string, sha1 string")
    versions = spark.createDataFrame(
        [("d", 1, "t", 1), ("d", 3, "t", 4), ("d", 9, "t", 9), ("d", 2, "u", 2), ("d", 2, "v", 6), ("d", 4, "w", 3), ("d", 5, "w", None),
         ("d", 1, "two", 7)], "dataset string, release int, table string, table_version int")
    seen = history.last_seen_by_file(local, checksums, versions)
    assert {(r.table, r.file, r.release, r.sha1, r.table_version) for r in seen.collect()} == {
        ("t", "t.parquet", 3, "h3", 4), ("w", "w.parquet", 4, "w4", 3), ("two", "a.parquet", 1, "a", 7), ("two", "b.parquet", 1, "b", 7)}
    assert {r.table: r.next_version for r in history.next_table_version(local, seen).collect()} == {
        "t": 4, "renamed_table": 1, "v": 1, "w": 4, "two": 7}


def test_rollup_files_are_read_as_written(spark, tmp_path):
    lines = spark.createDataFrame(
        [("a", 3, "", 0, 0, "version: 2"), ("a", 1, "", 0, 0, 'dataset: "a"'), ("b", 1, "", 0, 0, "dataset: b")],
        "dataset string, section int, order_file string, order_pos int, line_no int, line string")
    sinks.write_named(lines, "dataset", ["section"], str(tmp_path), lambda d: f"{d}.daml")
    assert (tmp_path / "a.daml").read_text() == 'dataset: "a"\nversion: 2\n'
    docs = S.read_documents(spark, f"{tmp_path}/*.daml")
    assert {r.file.rsplit("/", 1)[1]: r.raw for r in docs.collect()} == {"a.daml": '{"dataset": "a", "version": 2}', "b.daml": '{"dataset": "b"}'}


@pytest.mark.parametrize("name", ["release_findings", "validate_documents"])
def test_rows_of_all_documents_are_never_broadcast(spark, name):
    """Stored rows look small by their files, as these are compressed; only the rules' findings may be gathered."""
    import workload

    workload.load()
    plan = workload.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    gathered = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("key#" in line or "__name#" in line or "[column#" in line for line in gathered), gathered
