"""The whole release check, on datasets derived from line items.

A dataset for each supplier, a table for each of its line numbers, a document for each table, and a rollup
document for half of the datasets.  One supplier in sixteen has each of the faults below.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate.operators import profile, values
from tablegate.plans import suites
from tablegate.sources import inventory
from tablegate.sources.store import stored
from workload import documents as WD
from workload import inputs as I
from workload import names as W
from workload import reconcile as WC
from workload import rollups as WR
from workload.registry import query

FAIL, WARN = "CAST(2 AS TINYINT)", "CAST(1 AS TINYINT)"
LONG = "sold_quantity_of_every_order_line"  # a name that is warned about

# Fault of a supplier s (s % 16), in the table with the line number n.
CLASS = "s % 16"
SURVEY, OTHER_SET, NARROW, TYPE, COLUMNS, NO_DOC, NO_NOTES, EXTRA, VERSION, SENTINEL, ROLLUP_VERSION, ROLLUP_TABLES, \
    ROLLUP_SET, TAG, ANGLE = range(1, 16)


def fault(number: int, line: int | None = None) -> str:
    return f"({CLASS} = {number}" + (f" AND n = {line})" if line else ")")


DATASET, TABLE = "'supplier_' || CAST(s AS STRING)", "'t' || CAST(n AS STRING)"
LINES = "SELECT l_suppkey AS s, l_linenumber AS n, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem"
GROUPS = "SELECT DISTINCT l_suppkey AS s, l_linenumber AS n FROM lineitem"
COLUMNS_OF = {
    "ra": f"CASE WHEN {fault(ANGLE, 1)} THEN 400.0e0 ELSE l_discount * 1000 END",
    "quantity": "l_quantity",
    "tax": f"CASE WHEN {fault(SENTINEL, 3)} AND l_quantity >= 25 THEN -999.0e0 ELSE l_tax END",
    "flag": "l_returnflag",
    LONG: "CAST(l_quantity AS INT)",
}


def field(name: str, dtype: str, qc: str = "") -> str:
    return f'{{"name": "{name}", "unit": "--", "info": "x", "ucd": "meta.id", "data_type": "{dtype}"{qc}}}'


def literal(text: str) -> str:
    return W.literal(text)


RA = f"CASE WHEN {fault(TAG, 1)} THEN {literal(field('ra', 'float64').replace('meta.id', 'bad tag'))} " \
     f"ELSE {literal(field('ra', 'float64', ', \"qc\": {\"min\": 0.0, \"max\": 400.0}'))} END"
QUANTITY = f"CASE WHEN {fault(NARROW, 3)} THEN {literal(field('quantity', 'float64', ', \"qc\": {\"min\": 0.5, \"max\": 10.5}'))} " \
           f"ELSE {literal(field('quantity', 'float64', ', \"qc\": {\"min\": 0.5, \"max\": 50.5}'))} END"
TAX = f"CASE WHEN {fault(TYPE, 4)} THEN {literal(field('tax', 'int32'))} ELSE {literal(field('tax', 'float64'))} END"
FLAG = f"CASE WHEN {fault(COLUMNS, 5)} THEN {literal(field('shipmode', 'string'))} ELSE {literal(field('flag', 'string'))} END"
RAW = " || ".join([
    f"CASE WHEN {fault(SURVEY, 1)} THEN '{{\"survey\": null' ELSE '{{\"survey\": \"WAVES\"' END",
    f"', \"dataset\": \"' || CASE WHEN {fault(OTHER_SET, 2)} THEN 'elsewhere' ELSE {DATASET} END || '\"'",
    f"', \"table\": \"' || {TABLE} || '\", \"version\": ' || CAST((s + n) % 3 + 1 AS STRING)",
    "', \"date\": \"2024-05-06\", \"author\": \"Line ' || CAST(n % 3 AS STRING) || ' <l' || CAST(n % 3 AS STRING) || '@example.com>\"'",
    "', \"coauthors\": [\"Co ' || CAST(n % 2 AS STRING) || ' <c@example.org>\"]'",
    "', \"description\": \"Lines\", \"license\": \"MIT\", \"MAML_version\": 1.1, \"fields\": ['",
    RA, "', '", QUANTITY, "', '", TAX, "', '", FLAG, "', '", literal(field(LONG, "int32")), "']}'"])
NAMES = (
    ("TRUE", f"{TABLE} || '.parquet'"), (f"NOT {fault(NO_DOC, 1)}", f"{TABLE} || '.maml'"),
    (f"n = 1 AND NOT {fault(NO_NOTES)}", f"{DATASET} || '.md'"), ("n = 2", f"{TABLE} || '.md'"),
    (f"n = 1 AND {fault(EXTRA)}", "'scratch.tmp'"), ("n = 1 AND s % 2 = 0", f"{DATASET} || '.daml'"))
EXPECTED = f"CAST((s + n) % 3 + CASE WHEN {fault(VERSION, 2)} THEN 2 ELSE 1 END AS INT)"
LISTED = "CAST((s + n + CASE WHEN " + fault(ROLLUP_VERSION, 1) + " THEN 1 ELSE 0 END) % 3 + 1 AS STRING)"
LISTED_NAME = f"CASE WHEN {fault(ROLLUP_TABLES, 2)} THEN 't9' ELSE {TABLE} END"
RELEASE = "CAST(s % 5 + 1 AS INT)"


def rows(spark, sf):
    return I.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), "l_quantity", "l_discount", "l_tax", "l_returnflag")


def groups(spark, sf):
    return I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n")).distinct()


def given(spark, sf) -> suites.ReleaseInputs:
    of = groups(spark, sf)
    dataset, table = F.expr(DATASET).alias("dataset"), F.expr(TABLE).alias("table")
    data = rows(spark, sf).select(dataset, table, *[F.expr(e).alias(c) for c, e in COLUMNS_OF.items()])
    profiles = stored(profile.profile_groups(data, ["dataset", "table"]))  # as read_release keeps them
    files = of.select(dataset, F.explode(F.array_compact(F.array(*[
        F.expr(f"CASE WHEN {rule} THEN {name} END") for rule, name in NAMES]))).alias("name"))
    listed = F.array_join(F.array_sort(F.collect_list(F.expr(
        f"'{{\"name\": \"' || {LISTED_NAME} || '\", \"version\": ' || {LISTED} || '}}'"))), ", ")
    heads = of.where("s % 2 = 0").groupBy("s").agg(listed.alias("tables")).withColumn("n", F.lit(0))
    raw = " || ".join([
        f"'{{\"survey\": \"WAVES\", \"dataset\": \"' || CASE WHEN {fault(ROLLUP_SET)} THEN 'elsewhere' ELSE {DATASET} END",
        f"'\", \"version\": ' || CAST({RELEASE} AS STRING) || ', \"date\": \"2024-05-06\", \"author\": \"A <a@example.com>\"'",
        "', \"description\": \"Lines\", \"license\": \"MIT\", \"tables\": [' || tables || ']}'"])
    return suites.ReleaseInputs(
        files=inventory.classify(files),
        documents=of.where(f"NOT {fault(NO_DOC, 1)}").select(dataset, F.expr(f"{TABLE} || '.maml'").alias("name"), F.expr(RAW).alias("raw")),
        profiles=profiles, table_findings=values.validate_groups(data, ["dataset", "table"], "table", profiles=profiles),
        expected=of.where(f"NOT {fault(NO_DOC, 1)}").select(dataset, table, F.expr(EXPECTED).alias("next_version")),
        rollups=heads.select(dataset, F.expr(f"{DATASET} || '.daml'").alias("file"), F.expr(raw).alias("raw")),
        releases=of.select("s").distinct().select(dataset, F.expr(RELEASE).alias("next_release")),
        datasets=of.select("s").distinct().select(dataset), vocabulary=WD.field_vocabulary(spark, sf))


# --- the same in SQL -----------------------------------------------------------

DOCS_SQL = f"""lines AS MATERIALIZED ({LINES}), pairs AS MATERIALIZED ({GROUPS}),
docs AS MATERIALIZED (SELECT {DATASET} || '/' || {TABLE} || '.maml' AS file, {DATASET} AS dataset, {TABLE} AS "table",
    CAST({RAW} AS JSON) AS raw FROM pairs WHERE NOT {fault(NO_DOC, 1)})"""
SUITE_SQL = WD.SUITE_CTE.replace(I.DOCS_SQL, DOCS_SQL).replace(
    "replace(file, '.maml', '')", "regexp_extract(file, '([^/]*)[.]maml$', 1)")
NUMBERS = {"ra": "float64", "quantity": "float64", "tax": "float64", LONG: "int32"}
DATA = " UNION ALL ".join(
    [f"""SELECT {DATASET} AS dataset, {TABLE} AS "table", '{c}' AS "column", '{d}' AS dtype,
         CAST(min({COLUMNS_OF[c]}) AS DOUBLE) AS lo, CAST(max({COLUMNS_OF[c]}) AS DOUBLE) AS hi,
         bool_or({COLUMNS_OF[c]} = -999) AS hit FROM lines GROUP BY s, n""" for c, d in NUMBERS.items()]
    + [f"""SELECT {DATASET}, {TABLE}, 'flag', 'string', NULL, NULL, bool_or(l_returnflag = '-999') FROM lines GROUP BY s, n"""])
FILES = " UNION ALL ".join(f"SELECT {DATASET} AS dataset, {name} AS name FROM pairs WHERE {rule}" for rule, name in NAMES)
FOLDER = {k: v for k, v in WC.FOLDER_SQL.items()}
RELEASE_SQL = SUITE_SQL + f""",
    data AS MATERIALIZED ({DATA}),
    failing AS MATERIALIZED (SELECT DISTINCT file FROM findings WHERE severity = 2),
    good AS MATERIALIZED (SELECT * FROM docs WHERE file NOT IN (SELECT file FROM failing)),
    matched AS MATERIALIZED (
        SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a."table", b."table") AS "table",
               coalesce(a."column", b."column") AS "column", a."column" IS NOT NULL AS in_data,
               b."column" IS NOT NULL AS in_metadata, dtype, data_type, lo, hi, qc_min, qc_max
        FROM (SELECT data.* FROM data JOIN good USING (dataset, "table")) a FULL JOIN (
            SELECT dataset, "table", name AS "column", data_type, CAST({WD.at('min', 'qc')} AS VARCHAR) AS qc_min,
                   CAST({WD.at('max', 'qc')} AS VARCHAR) AS qc_max FROM good JOIN fields USING (file)) b
        ON a.dataset = b.dataset AND a."table" = b."table" AND a."column" = b."column"),
    files AS MATERIALIZED (SELECT DISTINCT dataset, name, regexp_replace(name, '\\.(maml|parquet|md)$', '') AS stem,
        CASE WHEN regexp_extract(name, '([^.]*)$', 1) IN ('maml', 'parquet', 'md')
             THEN regexp_extract(name, '([^.]*)$', 1) ELSE 'extra' END AS kind FROM ({FILES})),
    rolled AS (SELECT DISTINCT s FROM pairs WHERE s % 2 = 0),
    listed AS (SELECT {DATASET} AS dataset, {LISTED_NAME} AS name, CAST({LISTED} AS INTEGER) AS version FROM pairs WHERE s % 2 = 0),
    declared AS (SELECT {DATASET} AS dataset, {TABLE} AS name, CAST((s + n) % 3 + 1 AS INTEGER) AS version
        FROM pairs WHERE s % 2 = 0 AND NOT {fault(NO_DOC, 1)}),
    all_findings AS MATERIALIZED (
        SELECT dataset, "table", 'table' AS suite, "column" AS subject, 'sentinel_scan' AS "check", {FAIL} AS severity,
               'holds the missing-value sentinel' AS message FROM data WHERE hit
        UNION ALL SELECT dataset, "table", 'table', 'ra', 'ra_check', {FAIL}, 'ra not in [0, 360)' FROM data
            WHERE "column" = 'ra' AND NOT (lo >= 0 AND hi < 360)
        UNION ALL SELECT DISTINCT dataset, "table", 'table', '{LONG}', 'name_length', {WARN}, 'long: {len(LONG)} of 50' FROM data
        UNION ALL SELECT split_part(file, '/', 1), replace(split_part(file, '/', 2), '.maml', ''), 'document',
            split_part(file, '/', 2), "check", severity, message FROM findings
        UNION ALL SELECT dataset, "table", 'consistency', "column", "check", severity, message FROM (
            {' UNION ALL '.join(q.replace('SELECT "table"', 'SELECT dataset, "table"', 1) for q in (WC.PRESENCE, WC.TYPES, WC.DECLARED_RANGES))})
        UNION ALL SELECT split_part(file, '/', 1), replace(split_part(file, '/', 2), '.maml', ''), 'consistency', '',
            'document_failed', {FAIL}, 'not checked, its document failed' FROM failing
        UNION ALL SELECT dataset, NULL, 'folder', name, "check", severity, message FROM ({' UNION ALL '.join(FOLDER.values())})
        UNION ALL SELECT {DATASET}, NULL, 'folder', {TABLE} || '.maml', 'dataset_name_check', {FAIL}, 'names another dataset'
            FROM pairs WHERE {fault(OTHER_SET, 2)}
        UNION ALL SELECT {DATASET}, NULL, 'folder', {TABLE}, 'version_check', {FAIL},
            'version ' || CAST((s + n) % 3 + 1 AS STRING) || ' should be ' || {EXPECTED} FROM pairs WHERE {fault(VERSION, 2)}
        UNION ALL SELECT {DATASET}, NULL, 'rollup', {DATASET} || '.daml', 'rollup_dataset_match', {FAIL},
            'dataset should be ' || {DATASET} FROM rolled WHERE {fault(ROLLUP_SET)}
        UNION ALL SELECT coalesce(a.dataset, b.dataset), NULL, 'rollup', coalesce(a.name, b.name), 'rollup_tables_check', {FAIL},
            CASE WHEN a.name IS NULL THEN 'not in the rollup' WHEN b.name IS NULL THEN 'in no table document'
                 ELSE 'version ' || a.version || ' should be ' || b.version END
        FROM listed a FULL JOIN declared b ON a.dataset = b.dataset AND a.name = b.name
        WHERE a.name IS NULL OR b.name IS NULL OR a.version <> b.version),
    gate AS MATERIALIZED (SELECT {DATASET} AS dataset, s, s % 2 = 0 AS has_rollup, coalesce(max(severity), 0) < 2 AS passes
        FROM (SELECT DISTINCT s FROM pairs) LEFT JOIN all_findings ON dataset = {DATASET} GROUP BY s)"""


@query("release_findings", RELEASE_SQL + " SELECT * FROM all_findings")
def release_findings(spark, sf):
    """What all five suites find about all datasets."""
    return suites.release_findings(given(spark, sf))[0]


@query("release_gate", RELEASE_SQL + f"""
    SELECT CASE WHEN passes THEN 'passes' ELSE 'fails' END AS output, dataset, 1 AS n FROM gate
    UNION ALL SELECT 'manifest', dataset, count(*) + 3 FROM files JOIN gate USING (dataset)
    WHERE passes AND has_rollup GROUP BY 2
    UNION ALL SELECT 'rollup', {DATASET}, 7 + count(DISTINCT n % 2) + count(*) FROM pairs
    WHERE s IN (SELECT s FROM gate WHERE passes AND NOT has_rollup) GROUP BY s""")
def release_gate(spark, sf):
    """Which datasets pass, and how many rows are written for them: rollup lines or manifest lines."""
    inputs = given(spark, sf)
    hashes = inputs.files.select("dataset", "name", F.sha1("name").alias("sha1"))
    _, out = suites.check_release(inputs, hashes, WR.DATE)

    def counted(rows, label):
        return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(label).alias("output"), "dataset", "n")

    verdict = out.gate.select(F.when(F.col("passes"), "passes").otherwise("fails").alias("output"),
                              "dataset", F.lit(1).cast("bigint").alias("n"))
    return counted(out.rollups, "rollup").unionByName(counted(out.manifests, "manifest")).unionByName(verdict)
