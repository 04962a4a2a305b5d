"""Joins between files, manifests, columns and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate.operators import history as H
from tablegate.operators import profile
from tablegate.operators import reconcile as C
from tablegate.plans import suites
from workload import inputs as I
from workload.registry import query

FAIL = "CAST(2 AS TINYINT)"

# --- data against declared columns -------------------------------------------
#
# Data columns: one per line number of an order, typed by the order's parts.
# Declared columns: as many as the order's customer asks for.

DATA_SQL = """data AS MATERIALIZED (
    SELECT 'order_' || CAST(l_orderkey AS STRING) AS "table", 'line_' || CAST(l_linenumber AS STRING) AS "column",
           CASE WHEN min(l_partkey) % 5 = 0 THEN 'int32' ELSE 'float64' END AS dtype,
           min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2)"""
DECLARED_TYPE = "CASE WHEN (o_custkey + i) % 4 = 0 THEN 'Int32' ELSE 'Float64' END"
DECLARED_MIN = "CASE WHEN (o_orderkey + i) % 3 > 0 THEN CAST((o_orderkey + i) % 10 AS STRING) END"
DECLARED_MAX = "CASE WHEN (o_orderkey + i) % 3 > 0 THEN '45' END"
DECLARED_SQL = f"""declared AS MATERIALIZED (
    SELECT 'order_' || CAST(o_orderkey AS STRING) AS "table", 'line_' || CAST(i AS STRING) AS "column",
           {DECLARED_TYPE} AS data_type, {DECLARED_MIN} AS qc_min, {DECLARED_MAX} AS qc_max
    FROM orders, unnest(generate_series(1, o_custkey % 7 + 1)) AS g(i))"""
MATCHED_SQL = f"""WITH {DATA_SQL}, {DECLARED_SQL}, matched AS MATERIALIZED (
    SELECT coalesce(a."table", b."table") AS "table", coalesce(a."column", b."column") AS "column",
           a."table" IS NOT NULL AS in_data, b."table" IS NOT NULL AS in_metadata,
           dtype, data_type, lo, hi, qc_min, qc_max
    FROM data a FULL JOIN declared b ON a."table" = b."table" AND a."column" = b."column")"""


def data_columns(spark, sf):
    """Profile rows of the data columns."""
    lines = I.table(spark, sf, "lineitem").groupBy(
        F.expr("'order_' || CAST(l_orderkey AS STRING)").alias("table"),
        F.expr("'line_' || CAST(l_linenumber AS STRING)").alias("column"))
    return lines.agg(
        F.expr("CASE WHEN min(l_partkey) % 5 = 0 THEN 'int32' ELSE 'float64' END").alias("dtype"),
        F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("bigint").alias("n_null"),
        F.lit(0).cast("bigint").alias("n_nan"),
        F.min("l_quantity").cast("string").alias("min_value"),
        F.max("l_quantity").cast("string").alias("max_value"))


def declared_columns(spark, sf):
    rows = I.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.explode(F.expr("sequence(1, o_custkey % 7 + 1)")).alias("i"))
    return rows.select(
        F.expr("'order_' || CAST(o_orderkey AS STRING)").alias("table"),
        F.expr("'line_' || CAST(i AS STRING)").alias("column"),
        F.expr(DECLARED_TYPE).alias("data_type"), F.expr(DECLARED_MIN).alias("qc_min"),
        F.expr(DECLARED_MAX).alias("qc_max"))


PRESENCE = f"""SELECT "table", "column", 'column_presence' AS "check", {FAIL} AS severity,
    CASE WHEN in_data THEN 'in the data but not in the metadata'
         ELSE 'in the metadata but not in the data' END AS message
    FROM matched WHERE NOT (in_data AND in_metadata)"""
TYPES = f"""SELECT "table", "column", 'column_type_check' AS "check", {FAIL} AS severity,
    'declared ' || data_type || ', is ' || dtype AS message
    FROM matched WHERE lower(data_type) <> lower(dtype)"""
DECLARED_RANGES = f"""SELECT "table", "column", 'declared_range_check' AS "check", {FAIL} AS severity,
    'not in [' || qc_min || ', ' || qc_max || ']' AS message
    FROM matched WHERE in_data AND in_metadata
    AND NOT (lo >= CAST(qc_min AS DOUBLE) AND hi <= CAST(qc_max AS DOUBLE))"""


@query("column_presence", f"{MATCHED_SQL} {PRESENCE}")
def column_presence(spark, sf):
    return C.column_presence(data_columns(spark, sf), declared_columns(spark, sf))


@query("column_type_check", f"{MATCHED_SQL} {TYPES}")
def column_type_check(spark, sf):
    return C.column_type_check(data_columns(spark, sf), declared_columns(spark, sf))


@query("declared_range_check", f"{MATCHED_SQL} {DECLARED_RANGES}")
def declared_range_check(spark, sf):
    return C.declared_range_check(data_columns(spark, sf), declared_columns(spark, sf))


# The whole check on real columns: fields declared for three tables, some wrong.
FIELDS = {
    "lineitem": (("l_orderkey", "int64", "0", "99999999"), ("l_partkey", "int32", None, None),
                 ("l_quantity", "float64", "1.0", "49.0"), ("l_discount", "float64", "0.0", "0.1"),
                 ("l_tax", "float32", "0.0", "0.05"), ("l_returnflag", "string", None, None),
                 ("l_comment", "string", None, None)),
    "orders": (("o_orderkey", "int64", "1", "99999999"), ("o_custkey", "int64", None, None),
               ("o_totalprice", "float64", "1000.0", "500000.0"), ("o_orderstatus", "String", None, None),
               ("o_clerk", "string", None, None)),
    "events": (("event_id", "int64", None, None), ("value", "float64", "0.0", "100.0"),
               ("user_id", "int64", "0", "10"), ("ts", "string", None, None)),
}
FIELD_VALUES = ", ".join(
    f"('{t}', '{c}', '{d}', " + ", ".join("NULL" if v is None else f"'{v}'" for v in (lo, hi)) + ")"
    for t, rows in FIELDS.items() for c, d, lo, hi in rows)


def _consistency_sql():
    from workload.values import DTYPES
    numeric = ("int32", "int64", "float64")
    rows = []
    for t in FIELDS:
        for column in DTYPES[t].split(", "):
            c, d = column.split()
            extremes = f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)" if d in numeric \
                else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
            rows.append(f"SELECT '{t}', '{c}', '{d}', {extremes} FROM {t} HAVING count(*) >= 0")
    return f"""WITH data("table", "column", dtype, lo, hi) AS ({' UNION ALL '.join(rows)}),
        declared("table", "column", data_type, qc_min, qc_max) AS (VALUES {FIELD_VALUES}),
        matched AS (SELECT coalesce(a."table", b."table") AS "table", coalesce(a."column", b."column") AS "column",
           a."table" IS NOT NULL AS in_data, b."table" IS NOT NULL AS in_metadata,
           dtype, data_type, lo, hi, qc_min, qc_max
           FROM data a FULL JOIN declared b ON a."table" = b."table" AND a."column" = b."column")
        {PRESENCE} UNION ALL {TYPES} UNION ALL {DECLARED_RANGES}"""


@query("validate_consistency", _consistency_sql())
def validate_consistency(spark, sf):
    profiles = profile.profile_tables({t: I.table(spark, sf, t) for t in FIELDS})
    fields = spark.createDataFrame(
        [(t, *row) for t, rows in FIELDS.items() for row in rows],
        "table string, column string, data_type string, qc_min string, qc_max string")
    return C.validate_consistency(profiles, fields)


# --- release folders ---------------------------------------------------------

def folder(check, message, rows):
    return (f"SELECT dataset, name, '{check}' AS \"check\", {FAIL} AS severity, "
            f"'{message}' AS message FROM ({rows})")


def unpaired(check, kind, partner):
    return " UNION ALL ".join([
        folder(check, f"no .{partner} of the same name",
               f"SELECT * FROM files f WHERE kind = '{kind}' AND NOT EXISTS (SELECT 1 FROM files g "
               f"WHERE g.kind = '{partner}' AND g.dataset = f.dataset AND g.stem = f.stem)"),
        folder(check, f"no .{kind} files",
               f"SELECT dataset, '' AS name FROM files GROUP BY 1 HAVING count(*) FILTER (WHERE kind = '{kind}') = 0")])


NOTES = """SELECT dataset FROM files WHERE kind = 'md' AND name = dataset || '.md'"""
FOLDER_SQL = {
    "docs_without_table": unpaired("docs_without_table", "maml", "parquet"),
    "tables_without_doc": unpaired("tables_without_doc", "parquet", "maml"),
    "notes_check": " UNION ALL ".join([
        folder("notes_check", "notes of the dataset are missing",
               f"SELECT DISTINCT dataset, dataset || '.md' AS name FROM files WHERE dataset NOT IN ({NOTES})"),
        folder("notes_check", "no .parquet of the same name",
               f"SELECT * FROM files f WHERE kind = 'md' AND name <> dataset || '.md' AND dataset IN ({NOTES}) "
               "AND NOT EXISTS (SELECT 1 FROM files g WHERE g.kind = 'parquet' AND g.dataset = f.dataset "
               "AND g.stem = f.stem)")]),
    "extra_files": folder("extra_files", "unexpected file",
                          "SELECT * FROM files WHERE kind = 'extra' AND name <> dataset || '.checksums' "
                          "AND name <> dataset || '.daml'"),
}
for _name, _check in (("docs_without_table", C.docs_without_table),
                      ("tables_without_doc", C.tables_without_doc),
                      ("notes_check", C.notes_check), ("extra_files", C.extra_files)):
    def _run(spark, sf, check=_check):
        return check(I.files(spark, sf))
    query(_name, f"WITH {I.FILES_SQL} {FOLDER_SQL[_name]}")(_run)


@query("src_inventory", f"WITH {I.FILES_SQL} SELECT dataset, name, stem, kind FROM files")
def src_inventory(spark, sf):
    return I.files(spark, sf)


@query("dataset_name_check", f"""WITH {I.TABLE_DOCS_SQL} SELECT dataset, file AS name,
    'dataset_name_check' AS "check", {FAIL} AS severity, 'names another dataset' AS message
    FROM table_docs WHERE declared_dataset <> dataset""")
def dataset_name_check(spark, sf):
    docs = I.table_documents(spark, sf)
    return C.dataset_name_check(docs.withColumnRenamed("file", "name"))


# --- manifests ---------------------------------------------------------------

COMPARE_SQL = """SELECT * FROM (SELECT coalesce(e.dataset, c.dataset) AS dataset, coalesce(e.name, c.name) AS name,
    CASE WHEN c.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'extra'
         WHEN e.sha1 <> c.sha1 THEN 'mismatched' END AS status
    FROM expected e FULL JOIN computed c ON e.dataset = c.dataset AND e.name = c.name) WHERE status IS NOT NULL"""


@query("manifest_compare", f"WITH {I.HASHES_SQL} {COMPARE_SQL}")
def manifest_compare(spark, sf):
    return C.manifest_compare(I.expected_hashes(spark, sf), I.computed_hashes(spark, sf))


STORED = f"""SELECT source AS dataset, {I.PARQUET} AS name, CASE WHEN doc_id % 3 > 0 THEN
    'MD5:' || md5(text) || ' SHA1:' || sha1(text || 'stored') || ' ADLER32:0' ELSE 'MD5:' || md5(text) END AS hashes
    FROM documents"""


def stored_hashes(spark, sf):
    text = F.expr("CASE WHEN doc_id % 3 > 0 THEN 'MD5:' || md5(text) || ' SHA1:' || sha1(text || 'stored') "
                  "|| ' ADLER32:0' ELSE 'MD5:' || md5(text) END")
    from tablegate.sources.manifests import stored_hash
    return I.table(spark, sf, "documents").select(
        F.col("source").alias("dataset"), F.expr(I.PARQUET).alias("name"), text.alias("hashes")
    ).select("dataset", "name", stored_hash(F.col("hashes")).alias("sha1"))


@query("src_stored_hashes", f"""SELECT dataset, name, nullif(regexp_extract(hashes, 'SHA1:([0-9a-f]*)', 1), '') AS sha1
    FROM ({STORED})""")
def src_stored_hashes(spark, sf):
    return stored_hashes(spark, sf)


@query("hash_fill", f"""WITH {I.HASHES_SQL} SELECT s.dataset, s.name,
    coalesce(nullif(regexp_extract(hashes, 'SHA1:([0-9a-f]*)', 1), ''), c.sha1) AS sha1
    FROM ({STORED}) s LEFT JOIN computed c ON s.dataset = c.dataset AND s.name = c.name""")
def hash_fill(spark, sf):
    return C.hash_fill(stored_hashes(spark, sf), I.computed_hashes(spark, sf))


SUPPLIER_FILE = "CASE WHEN l_linenumber % 2 = 0 THEN 't' || CAST(l_linenumber AS STRING) || '.parquet' " \
    "ELSE 't' || CAST(l_linenumber AS STRING) || '.maml' END"
BUNDLE_SQL = f"""SELECT DISTINCT 'supplier_' || CAST(l_suppkey AS STRING) AS dataset, {SUPPLIER_FILE} AS name
    FROM lineitem"""


@query("submission_bundle", f"""WITH listing AS ({BUNDLE_SQL}),
    problems AS (SELECT DISTINCT 'supplier_' || CAST(l_suppkey AS STRING) AS dataset FROM lineitem
                 WHERE l_quantity > 49 AND l_discount >= 0.095 AND l_tax >= 0.075)
    SELECT dataset, name, name NOT LIKE '%.parquet' AS is_sent FROM listing
    WHERE dataset NOT IN (SELECT dataset FROM problems)""")
def submission_bundle(spark, sf):
    lines = I.table(spark, sf, "lineitem")
    dataset = F.expr("'supplier_' || CAST(l_suppkey AS STRING)").alias("dataset")
    listing = lines.select(dataset, F.expr(SUPPLIER_FILE).alias("name")).distinct()
    problems = lines.filter("l_quantity > 49 AND l_discount >= 0.095 AND l_tax >= 0.075").select(dataset)
    return C.submission_bundle(listing, problems)


# --- history -----------------------------------------------------------------

LAST_SEEN_SQL = f"""{I.STATES_SQL}, last_seen AS MATERIALIZED (
    SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY dataset, "table" ORDER BY release DESC) = 1)"""
NEXT_SQL = f"""{LAST_SEEN_SQL}, {I.LOCAL_SQL}, next_versions AS MATERIALIZED (
    SELECT l.dataset, l."table", CAST(CASE WHEN s.table_version IS NULL THEN 1
        WHEN s.sha1 = l.sha1 THEN s.table_version ELSE s.table_version + 1 END AS INTEGER) AS next_version
    FROM local_tables l LEFT JOIN last_seen s ON l.dataset = s.dataset AND l."table" = s."table")"""


@query("snapshot_last_seen", f"WITH {LAST_SEEN_SQL} SELECT * FROM last_seen")
def snapshot_last_seen(spark, sf):
    states = I.history_states(spark, sf)
    joined = H.snapshots(states.drop("table_version"), states.drop("sha1"))
    return H.snapshot_last_seen(joined)


def next_versions(spark, sf):
    return H.next_table_version(I.local_tables(spark, sf),
                                H.snapshot_last_seen(I.history_states(spark, sf)))


@query("next_table_version", f"WITH {NEXT_SQL} SELECT * FROM next_versions")
def next_table_version(spark, sf):
    return next_versions(spark, sf)


VERSION_SQL = f"""SELECT n.dataset, n."table", 'version_check' AS "check", {FAIL} AS severity,
    'version ' || l.version || ' should be ' || n.next_version AS message
    FROM next_versions n JOIN local_tables l ON n.dataset = l.dataset AND n."table" = l."table"
    WHERE l.version <> n.next_version"""


@query("version_check", f"WITH {NEXT_SQL} {VERSION_SQL}")
def version_check(spark, sf):
    return H.version_check(I.local_tables(spark, sf), next_versions(spark, sf))


RELEASES = "regexp_extract(folder, '^v(\\d+)$', 1)"
RELEASES_SQL = f"""{I.FOLDERS_SQL}, next_releases AS (
    SELECT dataset, CAST(coalesce(max(TRY_CAST({RELEASES} AS INTEGER)) + 1, 1) AS INTEGER) AS next_release
    FROM folders GROUP BY 1)"""


@query("next_release_version", f"""WITH {I.FOLDERS_SQL}, datasets AS (
        SELECT DISTINCT 'nation_' || CAST(c_nationkey AS STRING) AS dataset FROM customer),
    branched AS (SELECT 'branch_' || dataset AS dataset, TRY_CAST({RELEASES} AS INTEGER) AS v,
                 length(folder) = 2 AS on_branch FROM folders)
    SELECT d.dataset, CAST(coalesce(max(TRY_CAST({RELEASES} AS INTEGER)) + 1, 1) AS INTEGER) AS next_release
    FROM datasets d LEFT JOIN folders f ON d.dataset = f.dataset GROUP BY 1
    UNION ALL SELECT dataset, CAST(coalesce(max(v) FILTER (WHERE on_branch),
        max(v) FILTER (WHERE NOT on_branch) + 1, 1) AS INTEGER) FROM branched GROUP BY 1""")
def next_release_version(spark, sf):
    folders = I.release_folders(spark, sf)
    datasets = I.table_documents(spark, sf).select("dataset")
    branched = folders.select(
        F.concat(F.lit("branch_"), "dataset").alias("dataset"), "folder",
        (F.length("folder") == 2).alias("on_branch"))
    return H.next_release_version(folders, datasets).unionByName(H.next_release_version(branched))


# --- the folder suite --------------------------------------------------------
#
# Documents and versions of the folders: every labelled document declares one.

DECLARED_SET = "CASE WHEN toxic = 1 THEN 'elsewhere' ELSE source END"
LABELLED_SQL = f"""labelled AS (SELECT source AS dataset, {I.STEM} || '.maml' AS name, {I.STEM} AS "table",
    {DECLARED_SET} AS declared_dataset, CAST(quality + 1 AS INTEGER) AS version,
    CAST(n_chars % 2 + 1 AS INTEGER) AS next_version FROM documents JOIN labels USING (doc_id))"""


def labelled(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(I.table(spark, sf, "labels"), "doc_id")
    return rows.select(
        F.col("source").alias("dataset"), F.expr(f"{I.STEM} || '.maml'").alias("name"),
        F.expr(I.STEM).alias("table"), F.expr(DECLARED_SET).alias("declared_dataset"),
        F.expr("CAST(quality + 1 AS INT)").alias("version"),
        F.expr("CAST(n_chars % 2 + 1 AS INT)").alias("next_version"))


DIRECTORY_SQL = f"""{I.FILES_SQL}, {LABELLED_SQL}, folder_findings AS MATERIALIZED (
    SELECT dataset, name AS subject, "check", severity, message FROM ({' UNION ALL '.join(FOLDER_SQL.values())})
    UNION ALL SELECT dataset, name, 'dataset_name_check', {FAIL}, 'names another dataset'
    FROM labelled WHERE declared_dataset <> dataset
    UNION ALL SELECT dataset, "table", 'version_check', {FAIL},
        'version ' || version || ' should be ' || next_version FROM labelled WHERE version <> next_version)"""


def directory_findings(spark, sf):
    rows = labelled(spark, sf)
    return suites.check_directory(
        I.files(spark, sf), rows.select("dataset", "name", "declared_dataset"),
        rows.select("dataset", "table", "version"), rows.select("dataset", "table", "next_version"))


@query("check_directory", f"WITH {DIRECTORY_SQL} SELECT * FROM folder_findings")
def check_directory(spark, sf):
    return directory_findings(spark, sf)
