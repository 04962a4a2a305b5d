"""Rollup documents, reports and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate import rules as R
from tablegate.operators import documents as D
from tablegate.operators import history as H
from tablegate.operators import report, rollup
from workload import documents as WD
from workload import inputs as I
from workload import reconcile as WC
from workload import values as WV
from workload.registry import query

FAIL = "CAST(2 AS TINYINT)"

SURVEY_SQL = """SELECT dataset, CASE WHEN count(DISTINCT survey) = 1 THEN min(survey) ELSE 'WAVES' END AS survey
    FROM table_docs GROUP BY 1"""
AUTHOR_SQL = """SELECT dataset, author FROM (SELECT dataset, author, count(*) AS n, min(file) AS f
    FROM table_docs GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, f) = 1"""
COAUTHORS_SQL = """SELECT dataset, coauthor, file AS first_file, CAST(pos - 1 AS INTEGER) AS first_pos FROM (
    SELECT dataset, file, pos, coauthors[pos] AS coauthor
    FROM table_docs, unnest(generate_series(1, len(coauthors))) AS g(pos))
    QUALIFY row_number() OVER (PARTITION BY dataset, coauthor ORDER BY file, pos) = 1"""


@query("rollup_survey", f"WITH {I.TABLE_DOCS_SQL} {SURVEY_SQL}")
def rollup_survey(spark, sf):
    return rollup.rollup_survey(I.table_documents(spark, sf))


@query("rollup_dataset", f"""WITH {I.TABLE_DOCS_SQL} SELECT dataset,
    CASE WHEN count(DISTINCT declared_dataset) = 1 THEN min(declared_dataset) END AS declared_dataset,
    count(DISTINCT declared_dataset) = 1 AS is_single FROM table_docs GROUP BY 1""")
def rollup_dataset(spark, sf):
    return rollup.rollup_dataset(I.table_documents(spark, sf))


@query("rollup_author", f"WITH {I.TABLE_DOCS_SQL} {AUTHOR_SQL}")
def rollup_author(spark, sf):
    return rollup.rollup_author(I.table_documents(spark, sf))


@query("top1_author", """SELECT dataset, author FROM (
    SELECT o_orderpriority AS dataset, CAST(o_custkey AS STRING) AS author, count(*) AS n,
           min(lpad(CAST(o_orderkey AS STRING), 12, '0')) AS f FROM orders GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, f) = 1""")
def top1_author(spark, sf):
    """The customer with most orders per priority: five very large groups."""
    orders = I.table(spark, sf, "orders")
    return rollup.top1_author(orders.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").cast("string").alias("author"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file")))


@query("rollup_coauthors", f"WITH {I.TABLE_DOCS_SQL} {COAUTHORS_SQL}")
def rollup_coauthors(spark, sf):
    return rollup.rollup_coauthors(I.table_documents(spark, sf))


@query("rollup_tables", f'WITH {I.TABLE_DOCS_SQL} SELECT dataset, file, "table" AS name, version FROM table_docs')
def rollup_tables(spark, sf):
    return rollup.rollup_tables(I.table_documents(spark, sf))


DATE = "2024-05-06"
KEY = R.ROLLUP_KEYS.index


def scalar_sql(key, value, rows):
    return (f"SELECT dataset, {KEY(key)} AS section, '{key}' AS key, '' AS order_file, 0 AS order_pos, "
            f"{value} AS value, CAST(NULL AS INTEGER) AS version FROM ({rows})")


DATASETS_SQL = "SELECT DISTINCT dataset FROM table_docs"
BUILD_SQL = " UNION ALL ".join([
    scalar_sql("survey", "survey", SURVEY_SQL),
    scalar_sql("dataset", "dataset", DATASETS_SQL),
    scalar_sql("version", "CAST(coalesce(next_release, 1) AS STRING)",
               f"SELECT d.dataset, next_release FROM ({DATASETS_SQL}) d LEFT JOIN next_releases USING (dataset)"),
    scalar_sql("date", f"'{DATE}'", DATASETS_SQL),
    scalar_sql("author", "author", AUTHOR_SQL),
    scalar_sql("description", "CAST(NULL AS STRING)", DATASETS_SQL),
    scalar_sql("license", f"'{R.DEFAULT_LICENSE}'", DATASETS_SQL),
    f"SELECT dataset, {KEY('coauthors')}, 'coauthors', first_file, first_pos, coauthor, NULL FROM ({COAUTHORS_SQL})",
    f"SELECT dataset, {KEY('tables')}, 'tables', file, 0, \"table\", version FROM table_docs"])
BUILD_CTE = f"{I.TABLE_DOCS_SQL}, {WC.RELEASES_SQL}, built AS MATERIALIZED ({BUILD_SQL})"


def built(spark, sf):
    releases = H.next_release_version(I.release_folders(spark, sf))
    return rollup.build_rollup(I.table_documents(spark, sf), releases, DATE)


@query("build_rollup", f"WITH {BUILD_CTE} SELECT * FROM built")
def build_rollup(spark, sf):
    return built(spark, sf)


# --- checks on rollup documents ----------------------------------------------

def raw_found(check, condition, message, source="rollups", subject="file"):
    return (f"SELECT dataset, {subject} AS subject, '{check}' AS \"check\", {FAIL} AS severity, "
            f"{message} AS message FROM {source} WHERE {condition}")


def raw_required(check, key, expected):
    kind = WD.kind(WD.at(key))
    return [raw_found(check, f"{kind} = 'null'", f"'{key} is missing'"),
            raw_found(check, f"{kind} NOT IN ('{expected}', 'null')",
                      f"'{key} must be {expected}, got ' || {kind}")]


LISTED_SQL = f"""listed AS MATERIALIZED (
    SELECT dataset, {WD.text(WD.at('name', 'item'))} AS name,
           CAST({WD.text(WD.at('version', 'item'))} AS INTEGER) AS version
    FROM (SELECT dataset, json_extract({WD.at('tables')}, '$[' || i || ']') AS item
          FROM rollups, unnest(range(0, CAST(coalesce(json_array_length({WD.at('tables')}), 0) AS BIGINT))) AS g(i)))"""
DATASET_MATCH = [*raw_required("rollup_dataset_match", "dataset", "string"), raw_found(
    "rollup_dataset_match",
    f"{WD.kind(WD.at('dataset'))} = 'string' AND {WD.text(WD.at('dataset'))} <> dataset",
    "'dataset should be ' || dataset")]
VERSION_MATCH = [*raw_required("rollup_version_match", "version", "integer"), raw_found(
    "rollup_version_match",
    f"{WD.kind(WD.at('version'))} = 'integer' AND CAST({WD.text(WD.at('version'))} AS INTEGER) <> next_release",
    "'version should be ' || next_release", "rollups JOIN releases USING (dataset)")]
TABLES_CHECK = f"""SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.name, b.name) AS subject,
    'rollup_tables_check' AS "check", {FAIL} AS severity,
    CASE WHEN a.name IS NULL THEN 'not in the rollup' WHEN b.name IS NULL THEN 'in no table document'
         ELSE 'version ' || a.version || ' should be ' || b.version END AS message
    FROM listed a FULL JOIN supplier_tables b ON a.dataset = b.dataset AND a.name = b.name
    WHERE a.name IS NULL OR b.name IS NULL OR a.version <> b.version"""
ROLLUP_CTE = f"WITH {I.ROLLUPS_SQL}, {I.SUPPLIER_TABLES_SQL}, {I.SUPPLIER_RELEASES_SQL}, {LISTED_SQL} "


@query("src_rollup_tables", ROLLUP_CTE + "SELECT * FROM listed")
def src_rollup_tables(spark, sf):
    return rollup.listed_tables(D.open_documents(I.rollup_documents(spark, sf)))


@query("rollup_dataset_match", ROLLUP_CTE + WD.union(
    q.replace("SELECT dataset, file AS subject", "SELECT file", 1) for q in DATASET_MATCH))
def rollup_dataset_match(spark, sf):
    return rollup.rollup_dataset_match(D.open_documents(I.rollup_documents(spark, sf)))


@query("rollup_version_match", ROLLUP_CTE + WD.union(
    q.replace("SELECT dataset, file AS subject", "SELECT file", 1) for q in VERSION_MATCH))
def rollup_version_match(spark, sf):
    opened = D.open_documents(I.rollup_documents(spark, sf))
    return rollup.rollup_version_match(opened, I.supplier_releases(spark, sf))


@query("rollup_tables_check", ROLLUP_CTE + TABLES_CHECK.replace(" AS subject", " AS name", 1))
def rollup_tables_check(spark, sf):
    listed = rollup.listed_tables(D.open_documents(I.rollup_documents(spark, sf)))
    return rollup.rollup_tables_check(listed, I.supplier_tables(spark, sf))


ROLLUP_EMPTY = "list_contains(json_keys(raw), 'ancillary') AND " + WD.blank(WD.at("ancillary"))


@query("validate_rollup", ROLLUP_CTE + WD.union([
    *DATASET_MATCH, *VERSION_MATCH, TABLES_CHECK,
    *raw_required("doc_description", "description", "string"),
    raw_found("rollup_tables_check", f"{WD.kind(WD.at('tables'))} = 'null'", "'tables is missing'"),
    raw_found("doc_empty_optionals", ROLLUP_EMPTY, "'present but empty: ancillary'")]))
def validate_rollup(spark, sf):
    return rollup.validate_rollup(I.rollup_documents(spark, sf), I.supplier_tables(spark, sf),
                                  I.supplier_releases(spark, sf))


# --- reports and the gate ----------------------------------------------------
#
# Findings over line items: discounted lines warn, large lines fail, per supplier.

LINE_FINDINGS = """line_findings AS MATERIALIZED (
    SELECT l_suppkey AS supplier, 'order_' || CAST(l_orderkey % 10 AS STRING) AS "check",
           CAST(CASE WHEN l_quantity >= 49.5 AND l_partkey % 40 = 0 THEN 2 ELSE 1 END AS TINYINT) AS severity
    FROM lineitem WHERE l_discount >= 0.095)"""


def line_findings(spark, sf):
    return I.table(spark, sf, "lineitem").filter("l_discount >= 0.095").select(
        F.col("l_suppkey").alias("supplier"),
        F.expr("'order_' || CAST(l_orderkey % 10 AS STRING)").alias("check"),
        F.expr("CAST(CASE WHEN l_quantity >= 49.5 AND l_partkey % 40 = 0 THEN 2 ELSE 1 END AS TINYINT)")
        .alias("severity"))


def suppliers(spark, sf):
    return I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"))


STATES_CTE = f"""{LINE_FINDINGS}, states AS (
    SELECT supplier, "check", max(severity) AS severity FROM line_findings GROUP BY 1, 2)"""


@query("finding_severity", f"WITH {STATES_CTE} SELECT * FROM states")
def finding_severity(spark, sf):
    return report.finding_severity(line_findings(spark, sf), ["supplier"])


@query("report_rollup", f"""WITH {STATES_CTE}, rolled AS (
        SELECT s_suppkey AS supplier, coalesce(max(severity), 0) AS worst,
               coalesce(bool_or(severity = 1), FALSE) AS warned
        FROM supplier LEFT JOIN states ON s_suppkey = supplier GROUP BY 1)
    SELECT supplier, worst < 2 AS is_valid, warned AS has_warnings, CASE WHEN worst = 2 THEN 'INVALID'
        WHEN warned THEN 'VALID (with warnings)' ELSE 'VALID' END AS overall FROM rolled""")
def report_rollup(spark, sf):
    return report.report_rollup(line_findings(spark, sf), ["supplier"], suppliers(spark, sf))


CHECK_NAMES = [f"order_{i}" for i in range(10)]


@query("report_filter", f"""WITH {STATES_CTE}, checks AS (SELECT 'order_' || CAST(i AS STRING) AS "check"
        FROM range(0, 10) AS g(i))
    SELECT 'verbose' AS mode, s_suppkey AS supplier, c."check", CASE coalesce(severity, 0) WHEN 2 THEN 'FAIL'
        WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS state FROM supplier CROSS JOIN checks c
        LEFT JOIN states s ON s.supplier = s_suppkey AND s."check" = c."check"
    UNION ALL SELECT 'default', supplier, "check", CASE severity WHEN 2 THEN 'FAIL' ELSE 'WARNING' END FROM states""")
def report_filter(spark, sf):
    findings = line_findings(spark, sf)
    shown = report.report_filter(findings, ["supplier"])
    every = report.report_filter(findings, ["supplier"], CHECK_NAMES, suppliers(spark, sf), verbose=True)
    return shown.select(F.lit("default").alias("mode"), "*").unionByName(
        every.select(F.lit("verbose").alias("mode"), "*"))


@query("dataset_gate", f"""WITH {LINE_FINDINGS} SELECT CAST(s_suppkey AS STRING) AS dataset,
    coalesce(max(severity), 0) < 2 AS passes FROM supplier LEFT JOIN line_findings ON s_suppkey = supplier
    GROUP BY 1""")
def dataset_gate(spark, sf):
    findings = line_findings(spark, sf).withColumn("dataset", F.col("supplier").cast("string"))
    datasets = suppliers(spark, sf).select(F.col("supplier").cast("string").alias("dataset"))
    return report.dataset_gate(datasets, findings)


# --- the flagship: one pass over a table, to its report ------------------------

FLAGSHIP_SQL = """WITH hits AS (SELECT
        coalesce(bool_or({tax} = -999), FALSE) AS tax, coalesce(bool_or({line} = -999), FALSE) AS line,
        coalesce(bool_or({status} = '-999'), FALSE) AS status,
        NOT coalesce(bool_and(l_quantity >= 0 AND l_quantity < 40), TRUE) AS quantity FROM lineitem)
    SELECT 'sentinel_scan' AS "check", CASE WHEN tax OR line OR status THEN 'FAIL' ELSE 'PASS' END AS state FROM hits
    UNION ALL SELECT 'ra_check', CASE WHEN quantity THEN 'FAIL' ELSE 'PASS' END FROM hits
    UNION ALL SELECT 'dec_check', 'PASS' FROM hits""".format(
    tax=WV.FAULTY_LINE["l_tax"], line=WV.FAULTY_LINE["l_linenumber"], status=WV.FAULTY_LINE["l_linestatus"])


@query("table_report", FLAGSHIP_SQL)
def table_report(spark, sf):
    from tablegate.operators import values
    from tablegate.operators.values import RootRule

    rules = [RootRule("ra_check", "quantity", 0, 40, "left"), RootRule("dec_check", "discount", 0, 1, "both")]
    findings = values.validate_table(WV.faulty_lines(spark, sf), "lineitem", rules=rules)
    subject = spark.createDataFrame([("lineitem",)], "table string")
    return report.report_filter(
        findings, ["table"], ["sentinel_scan", "ra_check", "dec_check"], subject, verbose=True,
    ).select("check", "state")
