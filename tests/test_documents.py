import hashlib
import json

import yaml
from pyspark.sql import functions as F

from tablegate.functions import kinds
from tablegate.operators import documents as D
from tablegate.operators import history, infer, profile, reconcile, rollup
from tablegate.plans import suites
from tablegate.sources import documents as S
from tablegate.sources import inventory, manifests, sinks
from test_tags import vocabulary

GOOD = {
    "survey": "WAVES", "dataset": "stars", "table": "bright", "version": 1, "date": "2024-05-06",
    "author": "A Name <a.name@example.org>", "description": "", "license": "MIT", "MAML_version": 1.1,
    "fields": [{"name": "ra", "unit": "deg", "info": "x", "ucd": "pos.eq.ra", "data_type": "float64",
                "qc": {"min": 0.0, "max": 0.5}}]}


def findings(spark, documents):
    """Findings per document number, all documents checked in one job."""
    raws = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    docs = spark.createDataFrame(
        [(f"/{i}/bright.maml", raw) for i, raw in enumerate(raws)], "file string, raw string")
    out = {i: set() for i in range(len(raws))}
    for r in D.validate_documents(docs, vocabulary(spark)).collect():
        out[int(r.file.split("/")[1])].add((r.check, r.message))
    return out


def changed(**keys):
    return {**GOOD, **keys}


def test_faulty_documents(spark):
    field = GOOD["fields"][0]
    cases = [
        (changed(version=True), ("doc_version_int", "version must be integer, got boolean")),
        (changed(version=1.0), ("doc_version_int", "version must be integer, got number")),
        (changed(MAML_version=1), ("doc_schema_version", "MAML_version must be number, got integer")),
        (changed(date="2024-02-30"), ("doc_date", "not an ISO date: 2024-02-30")),
        (changed(author="Nobody"), ("doc_author", "not 'Name <address>': Nobody")),
        (changed(coauthors=[]), ("doc_coauthors", "coauthors is an empty list")),
        (changed(extra=1), ("doc_no_extra_keys", "unexpected: extra")),
        (changed(keywords=""), ("doc_empty_optionals", "present but empty: keywords")),
        (changed(fields=None), ("fields_shape", "fields is missing")),
        (changed(fields=[{}]), ("fields_shape", "fields[1]: empty")),
        (changed(fields=[field, field, field]), ("fields_duplicates", "fields[3]: ra repeats 1,2")),
        (changed(fields=[{**field, "qc": {"min": 0, "max": 0}}]),
         ("fields_qc", "fields[1]: integer qc on a float field")),
        (changed(fields=[{**field, "qc": {"min": None, "max": 1.5}}]), ("fields_qc", "fields[1]: qc lacks min")),
        (changed(fields=[{**field, "ucd": "nope"}]), ("ucd_validate", "fields[1]: unknown word nope")),
        (changed(fields=[{**field, "name": "ra_deg"}]), ("fields_names", "ra_deg: use ra")),
        ("[1, 2]", ("src_documents", "not a readable mapping")),
    ]
    swapped = {**{k: v for k, v in GOOD.items() if k != "survey"}, "survey": "WAVES"}
    cases += [(swapped, ("doc_key_order", "expected order: " + ", ".join(GOOD))), (GOOD, None)]
    found = findings(spark, [doc for doc, _ in cases])
    for i, (_, expected) in enumerate(cases):
        assert expected in found[i] if expected else found[i] == set(), (expected, found[i])


def test_iso_dates(spark):
    good = ["2024-02-29", "20240229", "2020-W53", "2020-W53-7", "2020W537"]
    bad = ["2023-02-29", "0000-01-01", "2021-W53", "2020-W00", "2020-W53-8", "2024-2-1", "soon", ""]
    df = spark.createDataFrame([(d,) for d in good + bad], "d string")
    got = {r.d for r in df.filter(D.is_iso_date(F.col("d"))).collect()}
    assert got == set(good)


LINTED = {
    "a: 1": None, "a:1": 1, "# a:1": None, "  a: http://x.y": None, 't: "a:b"': None, "t: 'a:b'": None,
    "at: 12:30": None, "ucd: ivoa:meta": None, "x: y:z": 1, 'q: "a\\" b:c"': None, "k:": None, "a::b": 1,
    "time:5": 1, "u: ftp://h:p": 1,
}


def test_colon_lint(spark):
    df = spark.createDataFrame([(t, t) for t in LINTED], "file string, text string")
    got = {r.file for r in S.lint_documents(df).collect()}
    assert got == {t for t, bad in LINTED.items() if bad}
    two = spark.createDataFrame([("f", "a: 1\nb:2\nc:3")], "file string, text string")
    assert [r.message for r in S.lint_documents(two).collect()] == ["no space after colon on line 2"]


def test_documents_are_read_from_files(spark, tmp_path):
    (tmp_path / "good.maml").write_text(yaml.safe_dump(GOOD, sort_keys=False))
    (tmp_path / "broken.maml").write_text("a: [1,\nb: 2")
    (tmp_path / "text.maml").write_text("just text")
    (tmp_path / "dates.maml").write_text("survey: WAVES\r\ndate: 2024-05-06\r\nx: .inf\r\n")
    rows = {r.file.rsplit("/", 1)[1]: r for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert json.loads(rows["good.maml"].raw) == GOOD
    assert rows["broken.maml"].raw is None and rows["broken.maml"].parse_error
    assert "mapping" in rows["text.maml"].parse_error
    assert json.loads(rows["dates.maml"].raw) == {
        "survey": "WAVES", "date": "2024-05-06", "x": kinds.NON_FINITE + "Infinity"}


def test_inventory_and_hashes(spark, tmp_path):
    folder = tmp_path / "stars"
    folder.mkdir()
    contents = {"bright.parquet": b"x" * 5000, "bright.maml": b"a", "stars.md": b"", "odd.v2.txt": b"t"}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    kinds = {r.name: (r.dataset, r.stem, r.kind) for r in inventory.inventory(spark, [str(folder)]).collect()}
    assert kinds["bright.parquet"] == ("stars", "bright", "parquet")
    assert kinds["odd.v2.txt"] == ("stars", "odd.v2.txt", "extra")
    want = {n: hashlib.sha1(c).hexdigest() for n, c in contents.items()}
    listing = inventory.file_listing(spark, [str(folder)]).collect()
    assert {r.file_name: r.sha1 for r in listing} == want
    hashes = spark.createDataFrame([("stars", n, h) for n, h in want.items()],
                                   "dataset string, name string, sha1 string")
    sinks.write_manifests(hashes, str(tmp_path / "out"))
    again = manifests.read_manifests(spark, str(tmp_path / "out/*/*.checksums"))
    assert reconcile.manifest_compare(again, hashes).count() == 0


def test_manifest_lines_parse(spark):
    text = "# c: x\n\n a.parquet : one:two \nnocolon\n: x\ny:\na.parquet: last\n"
    texts = spark.createDataFrame([("d", text)], "dataset string, text string")
    rows = manifests.parse_manifest(manifests.text_lines(texts, ["dataset"], "text"), ["dataset"]).collect()
    assert [(r.name, r.sha1) for r in rows] == [("a.parquet", "last")]


def test_history(spark):
    states = spark.createDataFrame(
        [("d", "t", 9, "h9", 3), ("d", "t", 10, "h10", 4), ("d", "u", 1, "x", None), ("d", "w", 2, "same", 7)],
        "dataset string, table string, release int, sha1 string, table_version int")
    local = spark.createDataFrame([("d", "t", "new"), ("d", "u", "x"), ("d", "w", "same"), ("d", "n", None)],
                                  "dataset string, table string, sha1 string")
    got = {r.table: r.next_version for r in history.next_table_version(
        local, history.snapshot_last_seen(states)).collect()}
    assert got == {"t": 5, "u": 1, "w": 7, "n": 1}
    folders = spark.createDataFrame([("d", "v9"), ("d", "v10"), ("d", "vx"), ("d", "v11a"), ("e", "x")],
                                    "dataset string, folder string")
    assert {r.dataset: r.next_release for r in history.next_release_version(folders).collect()} == {"d": 11, "e": 1}


def test_skeletons_and_rollups_are_valid_yaml(spark, tmp_path):
    df = spark.createDataFrame([(1, 1e-9, "x", True), (2, 3e20, "y", False)],
                               "uberID bigint, mag_u_SDSS double, note string, flag boolean")
    fields = infer.infer_fields(profile.profile_table(df, "bright"), vocabulary(spark))
    sinks.write_skeletons(fields, "2024-05-06", str(tmp_path / "skeleton"))
    doc = yaml.safe_load((tmp_path / "skeleton" / "bright.maml").read_text())
    assert doc["table"] == "bright" and doc["survey"] is None and doc["MAML_version"] == 1.1
    assert [f["name"] for f in doc["fields"]] == ["uberID", "mag_u_SDSS", "note", "flag"]
    assert doc["fields"][0]["qc"] == {"min": 1, "max": 2}
    assert doc["fields"][1]["qc"] == {"min": 1e-9, "max": 3e20}
    assert "qc" not in doc["fields"][2] and "qc" not in doc["fields"][3]

    docs = spark.createDataFrame(
        [("stars", "b.maml", "WAVES", "b", 2, "X <x@e.org>", ["P", "Q"]),
         ("stars", "a.maml", "WAVES", "a", 1, "Y <y@e.org>", ["Q", "R"]),
         ("stars", "c.maml", "WAVES", "c", 1, "X <x@e.org>", None)],
        "dataset string, file string, survey string, table string, version int, author string, "
        "coauthors array<string>")
    releases = spark.createDataFrame([("stars", 4)], "dataset string, next_release int")
    built = rollup.build_rollup(docs, releases, "2024-05-06")
    sinks.write_rollups(built, str(tmp_path / "rollup"))
    doc = yaml.safe_load((tmp_path / "rollup" / "stars" / "stars.daml").read_text())
    assert list(doc) == ["survey", "dataset", "version", "date", "author", "coauthors", "description",
                         "license", "tables"]
    assert doc["coauthors"] == ["Q", "R", "P"] and doc["author"] == "X <x@e.org>"
    assert doc["version"] == 4 and doc["description"] is None
    assert doc["tables"] == [{"name": n, "version": v} for n, v in (("a", 1), ("b", 2), ("c", 1))]


def test_folder_checks(spark):
    files = inventory.classify(spark.createDataFrame(
        [("stars", n) for n in ("a.parquet", "a.maml", "b.maml", "c.parquet", "a.md", "z.md", "stars.md",
                                "stars.daml", "junk.txt")] + [("bare", "x.txt")],
        "dataset string, name string"))
    docs = spark.createDataFrame([("stars", "a.maml", "stars"), ("stars", "b.maml", None)],
                                 "dataset string, name string, declared_dataset string")
    declared = spark.createDataFrame([("stars", "a", 1)], "dataset string, table string, version int")
    expected = spark.createDataFrame([("stars", "a", 2)], "dataset string, table string, next_version int")
    got = {(r.dataset, r.subject, r.check)
           for r in suites.check_directory(files, docs, declared, expected).collect()}
    assert got == {
        ("stars", "b.maml", "docs_without_table"), ("stars", "c.parquet", "tables_without_doc"),
        ("stars", "z.md", "notes_check"), ("stars", "junk.txt", "extra_files"),
        ("stars", "b.maml", "dataset_name_check"), ("stars", "a", "version_check"),
        ("bare", "", "docs_without_table"), ("bare", "", "tables_without_doc"),
        ("bare", "bare.md", "notes_check"), ("bare", "x.txt", "extra_files")}


def test_only_the_wanted_keys_and_parts_are_opened(spark):
    """A check of few keys finds the same on a document opened for these alone."""
    from tablegate.functions.findings import explode_findings
    from tablegate.operators import documents as D

    raws = ['{"date": "soon", "fields": [{"name": "a"}, {}, null, 5, {"name": "a", "qc": {"min": 1}, "data_type": "x"}]}',
            '{"fields": [[], "", {"name": ""}]}', '{"date": null, "fields": {}}', '[1]', 'no', None]
    docs = spark.createDataFrame(list(enumerate(raws)), "file string, raw string")

    def found(opened, check):
        return sorted(map(tuple, explode_findings(opened, ["file"], check).collect()))

    whole = D.open_fields(D.open_documents(docs))
    assert found(D.open_documents(docs, ("date",)), D.date()) == found(whole, D.date())
    for check, parts in ((D.fields_shape(), ()), (D.fields_required(), ("missing",)), (D.fields_duplicates(), ("name",)),
                         (D.fields_qc(), ("keys", "data_type", "qc_blank", "qc_is_object", "qc_keys", "min_kind", "max_kind"))):
        assert found(D.open_fields(D.open_documents(docs, ("fields",)), parts), check) == found(whole, check) != []


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_are_not_read_a_second_time_for_a_filter(spark):
    docs = spark.createDataFrame([("a.maml", '{"survey": "WAVES"}'), ("b.maml", "{")], "file string, raw string")
    made = docs.repartition("file").select("file", F.concat("raw", F.lit(" ")).alias("raw"))
    headers = D.documents_to_headers(made)
    assert _plan(headers).count("jsonObjectKeys") == 1
    assert [(r.file, r.survey) for r in headers.collect()] == [("a.maml", "WAVES")]


def test_checks_of_fields_leave_the_kinds_of_values_alone(spark):
    from tablegate.functions.findings import explode_findings

    docs = spark.createDataFrame([("a.maml", '{"fields": [{"name": "x", "data_type": "text"}, {}, 3]}')], "file string, raw string")
    for parts, check in ((("data_type",), D.fields_data_type()), (("missing",), D.fields_required()), (("keys",), D.fields_extra_keys())):
        rows = explode_findings(D.open_fields(D.open_documents(docs, ("fields",)), parts), ["file"], check)
        assert "transform_values" not in _plan(rows)


def test_document_texts_are_not_compiled_as_one_method(spark):
    from workload import inputs as I

    made = [line for line in _plan(I.documents(spark, "/root/testdata/sf0.001")).splitlines() if "MAML_version" in line]
    assert made and not any("*(" in line for line in made)


def test_falsy_values_by_their_text_are_those_by_their_json(spark):
    values = ["null", '""', "[]", "{}", "false", "true", "0", "0.0", "-0.0", "0.00", "-0", "0e0", "0.0e0", "1", '"0"', '"0.0"', '"false"', '"null"',
              '"[]"', '"{}"', '" "', "[0]", '{"a": null}', "0.1", '"x"', "00000000000000000000.0", "123456789012345678901"]
    held = spark.createDataFrame([(v,) for v in values], "text string").select("text", F.try_parse_json("text").alias("v"))
    rows = held.select("text", kinds.is_falsy(F.col("v")).alias("short"), kinds.falsy_text(kinds.json_text(F.col("v"))).alias("full")).collect()
    assert [r for r in rows if r.short != r.full] == []


def test_frequent_values_meet_their_findings_without_being_dealt_out(spark):
    rows = spark.createDataFrame(
        [(f"f{i}", name) for name, n in (("hot", 5), ("good", 4), ("rare", 2), ("fine", 1), (None, 6)) for i in range(n)],
        "file string, name string")
    of_name = spark.createDataFrame([("hot", [1, 2]), ("rare", [3])], "name string, as array<int>")
    met = D._meet(rows, of_name, ["name"], frequent=4)
    found = [tuple(r) for r in met.select("file", "name", F.inline_outer(F.transform("as", lambda a: F.struct(a.alias("a"))))).filter(
        "a IS NOT NULL").collect()]
    assert sorted(found) == sorted(
        [(f"f{i}", "hot", a) for i in range(5) for a in (1, 2)] + [(f"f{i}", "rare", 3) for i in range(2)])
    assert "Join LeftAnti" in met._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_a_rollup_are_lines_as_they_stand(spark):
    """They are not counted, and what is counted is dealt out first, so that no task sorts a whole file's rows."""
    docs = spark.createDataFrame(
        [("stars", f, "WAVES", "t", 1, "X <x@e.org>", ["P", "Q"]) for f in ("a.maml", "b.maml", "b.maml")],
        "dataset string, file string, survey string, table string, version int, author string, coauthors array<string>")
    built = rollup.build_rollup(docs, spark.createDataFrame([("stars", 4)], "dataset string, next_release int"), "2024-05-06")
    lines = [(r.order_file, r.value, r.version) for r in built.filter("key = 'tables'").collect()]
    assert sorted(lines) == sorted((r.file, r.name, r.version) for r in rollup.rollup_tables(docs).collect())
    assert "RepartitionByExpression" in built._jdf.queryExecution().optimizedPlan().toString()


def test_tags_of_known_texts_are_those_of_the_patterns():
    """A plain scalar's tag is looked up by its text; quoted ones, and texts met before, keep theirs."""
    parser, loader = S._loader()
    text = 'a: 1\nb: "1"\nc: 1.5\nd: yes\ne: "yes"\nf: null\ng: .nan\nh: 1\n2: [1, "1", ~, 0x1F, 1_000]\nlong: ' + "9" * 80
    first, again = (repr(parser.load(text, Loader=loader)) for _ in range(2))
    assert first == again == repr(parser.load(text, Loader=parser.SafeLoader))
    calls = []
    base = loader.__mro__[1]
    base_resolve = base.resolve
    try:
        base.resolve = lambda self, *args: calls.append(args) or base_resolve(self, *args)
        _, counted = S._loader()
        parser.load("- word\n" * 50, Loader=counted)
    finally:
        del base.resolve
    assert sum(args[1] == "word" for args in calls) == 1
