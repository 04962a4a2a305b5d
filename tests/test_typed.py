"""Documents opened once: plans, typed headers, values that JSON cannot hold, repeated names."""

import json
import time

import yaml
from pyspark.sql import functions as F

from tablegate.functions import kinds as K
from tablegate.operators import documents as D, history, reconcile, rollup
from tablegate.sources import documents as S
from tablegate.sources import vocabulary as V

GOOD = {
    "survey": "WAVES", "dataset": "stars", "table": "bright", "version": 2, "date": "2024-05-06",
    "author": "A B <a@example.com>", "coauthors": ["C D <c@example.org>"],
    "DOIs": [{"DOI": "10.1/x", "type": "self"}],
    "depends": [{"survey": "WAVES", "dataset": "d", "table": "t", "version": 3}],
    "description": "Bright stars", "comments": ["one", 2], "license": "MIT", "keywords": ["k"], "MAML_version": 1.1,
    "fields": [{"name": "star_id", "unit": "--", "info": "key", "ucd": "meta.id", "data_type": "int64"},
               {"name": "star_id", "unit": "m", "info": "key", "ucd": "meta.id", "data_type": "int32"}]}
MARK = K.NON_FINITE


def mapped(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")


def frame(spark, docs):
    return spark.createDataFrame([(f, json.dumps(d)) for f, d in docs.items()], "file string, raw string")


def test_documents_are_read_and_opened_once(spark, tmp_path):
    for name in ("bright", "faint"):
        (tmp_path / f"{name}.maml").write_text(yaml.safe_dump(GOOD | {"table": name}, sort_keys=False))
    words = V.vocabulary(spark.createDataFrame([("P", "meta.id", "x")], "type string, name string, descr string"))
    docs = S.read_documents(spark, f"{tmp_path}/*.maml")
    assert mapped(docs) == 1 and docs._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    typed = D.typed_documents(docs)
    assert mapped(typed) == 1
    findings = D.validate_documents(docs, words)
    assert mapped(findings) == 0  # read from the table that the one opening left
    assert mapped(D.documents_to_fields(docs, findings)) == 1
    assert {(r.file.rsplit("/", 1)[1], r.check) for r in findings.collect()} == {
        ("bright.maml", "fields_duplicates"), ("faint.maml", "fields_duplicates")}


def test_headers_are_typed(spark):
    odd = GOOD | {"version": "2", "coauthors": [], "survey": 5, "MAML_version": 1, "keywords": "k", "DOIs": [7], "dataset": None}
    docs = frame(spark, {"bright.maml": GOOD, "odd.maml": odd, "none.maml": []})
    rows = {r.file: r.asDict(recursive=True) for r in D.documents_to_headers(docs).collect()}
    assert set(rows) == {"bright.maml", "odd.maml"}
    good = {k: v for k, v in rows["bright.maml"].items() if k != "file"}
    assert good == {
        **{k: GOOD[k] for k in ("survey", "dataset", "table", "version", "date", "author", "coauthors", "description", "license", "keywords")},
        "dois": [{"doi": "10.1/x", "doi_type": "self"}], "comments": ["one", "2"], "maml_version": 1.1,
        "depends": [{"survey": "WAVES", "dataset": "d", "table": "t", "version": "3"}]}
    none = {k: v for k, v in rows["odd.maml"].items() if v is None}
    assert set(none) == {"version", "coauthors", "survey", "maml_version", "keywords", "dataset"}
    assert rows["odd.maml"]["dois"] == [{"doi": None, "doi_type": None}]
    failed = spark.createDataFrame([("odd.maml", 2), ("bright.maml", 1)], "file string, severity int")
    assert [r.file for r in D.documents_to_headers(docs, failed).collect()] == ["bright.maml"]


def test_checks_run_on_headers(spark):
    docs = frame(spark, {"a.maml": GOOD | {"table": "a"}, "b.maml": GOOD | {"table": "b", "dataset": "other", "survey": "SURVEY9", "version": 5}})
    headers = D.documents_to_headers(docs).withColumn("declared_dataset", F.col("dataset")).withColumn("dataset", F.lit("stars"))
    wrong = reconcile.dataset_name_check(headers.withColumnRenamed("file", "name")).collect()
    assert [(r.dataset, r.name) for r in wrong] == [("stars", "b.maml")]
    expected = spark.createDataFrame([("stars", "a", 2), ("stars", "b", 4)], "dataset string, table string, next_version int")
    assert [(r.table, r.message) for r in history.version_check(headers, expected).collect()] == [("b", "version 5 should be 4")]
    built = rollup.build_rollup(headers, spark.createDataFrame([("stars", 3)], "dataset string, next_release int"), "2024-01-01")
    rows = {(r.key, r.value, r.version) for r in built.collect()}
    assert {("survey", "WAVES", None), ("version", "3", None), ("author", GOOD["author"], None), ("coauthors", GOOD["coauthors"][0], None),
            ("tables", "a", 2), ("tables", "b", 5)} <= rows


def test_texts_that_begin_with_the_mark(spark):
    texts = {f"{k}": yaml.safe_dump(v, allow_unicode=True) for k, v in {
        "inf": {"survey": MARK + "Infinity", "author": MARK + "abc", "table": MARK * 2}, "number": {"survey": float("inf")}}.items()}
    docs = S.parse_documents(spark.createDataFrame(list(texts.items()), "file string, text string"))
    opened = D.open_documents(docs)
    rows = {r.file: r for r in opened.select(
        "file", D.kind_of("survey").alias("survey"), D.kind_of("author").alias("author"), K.as_text(D.value("survey")).alias("text"),
        K.as_text(D.value("author")).alias("abc"), K.as_text(D.value("table")).alias("two")).collect()}
    assert (rows["inf"].survey, rows["inf"].author, rows["inf"].text) == (K.STRING, K.STRING, MARK + "Infinity")
    assert (rows["inf"].abc, rows["inf"].two) == (MARK + "abc", MARK * 2)
    assert (rows["number"].survey, rows["number"].text) == (K.NUMBER, "Infinity")


def test_repeated_names_are_found_in_linear_time(spark):
    def found(names):
        fields = [GOOD["fields"][0] | {"name": n} for n in names]
        opened = D.open_fields(D.open_documents(frame(spark, {"f": GOOD | {"fields": fields}})))
        return sorted(m for r in opened.select(F.transform(D.fields_duplicates(), lambda f: f["message"]).alias("m")).collect() for m in r.m)

    assert found(["a", "b", "a", "c", "b", "a"]) == [
        "fields[3]: a repeats 1", "fields[5]: b repeats 2", "fields[6]: a repeats 1,3"]
    assert found(["a"]) == [] and found([]) == []
    start = time.time()
    many = [f"c{i}" for i in range(10_000)]
    assert found([*many, "c7"]) == ["fields[10001]: c7 repeats 8"]
    assert len(found([*many, *many])) == 10_000
    assert time.time() - start < 60


def test_elements_are_judged_as_rows_and_as_the_checks_of_arrays_do(spark):
    """Fields and other elements of lists are rows of their own, compiled and not interpreted, with the same findings."""
    from tablegate.functions.findings import explode_findings

    field, odd = GOOD["fields"][0], [None, "", 0, "a", [], {}, [1], {"name": "x", "zz": 1}, MARK + "NaN", 10**30]
    docs = {"good": GOOD | {"fields": [field]}, "none": [], "repeated": GOOD | {"fields": [field, 1, field, {}]},
            "swapped": dict(reversed(GOOD.items()))}
    for i, v in enumerate(odd):
        docs[f"list{i}"] = GOOD | {key: [v, *GOOD[key]] for key in ("coauthors", "DOIs", "depends", "comments", "keywords", "fields")}
        docs[f"key{i}"] = GOOD | {key: v for key in ("coauthors", "DOIs", "depends", "comments", "keywords", "fields", "date", "author")}
        docs[f"field{i}"] = GOOD | {"fields": [{**field, key: v} for key in ("name", "data_type", "qc", "also")], "aux": v}
        docs[f"qc{i}"] = GOOD | {"fields": [{**field, "qc": {"min": v, "max": 1, **more}} for more in ({}, {"step": v})]}
    given = frame(spark, docs)
    typed = D.typed_documents(given)
    opened = D.open_fields(D.open_documents(given)).filter("keys IS NOT NULL")
    checks = [D.coauthors(), D.dois(), D.depends(), D.comments(), D.keywords(), D.fields_shape(), D.fields_required(), D.fields_duplicates(),
              D.fields_data_type(), D.fields_qc(), D.fields_extra_keys(), D.empty_optionals(), D.no_extra_keys(), D.key_order(), D.author(), D.date()]
    arrays = sorted(map(tuple, explode_findings(opened, ["file"], *checks).collect()))
    names_of = {check for _, check, _, _ in arrays}
    rows = typed.select("file", F.inline_outer("found")).filter("check IS NOT NULL").collect()
    assert len(names_of) == 16 and sorted(tuple(r) for r in rows if r.check in names_of) == arrays
    of_good = typed.filter("file = 'good'").collect()
    assert sorted((r.header is not None, r.table, r.field and r.field.name, [f.check for f in r.found]) for r in of_good) == [
        (False, "bright", "star_id", []), (True, "bright", None, ["doc_table_matches_file"])]
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert "transform_values" not in plan and plan.count("Generate") == 2
