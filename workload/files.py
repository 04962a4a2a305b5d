"""Typed headers, published files and rule files: what is written is read again by the package's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate.operators import documents as D
from tablegate.operators import history as H
from tablegate.sources import documents as S
from tablegate.sources import inventory, manifests, rulefiles, sinks
from tablegate.sources.store import new_folder
from workload import documents as WD
from workload import inference as N
from workload import inputs as I
from workload import rollups as W
from workload.registry import query


# --- headers -------------------------------------------------------------------

def scalar(key: str, kind: str, cast: str) -> str:
    return f"CASE WHEN {WD.kind(WD.at(key))} = '{kind}' THEN CAST({WD.text(WD.at(key))} AS {cast}) END"


def joined(key: str, item: str) -> str:
    """A list's elements, by commas; null for anything else and for none."""
    return (f"CASE WHEN {WD.kind(WD.at(key))} = 'list' AND json_array_length({WD.at(key)}) > 0 THEN "
            f"coalesce(array_to_string(list_transform(range(0, CAST(json_array_length({WD.at(key)}) AS BIGINT)), "
            f"lambda i: {item}), ','), '') END")


def member(key: str, name: str = "") -> str:
    path = f"'$[' || i || ']{'.' + name if name else ''}'"
    return f"json_extract_string({WD.at(key)}, {path})"


def pairs(key: str, names) -> str:
    return " || '/' || ".join(f"coalesce({member(key, n)}, '')" for n in names)


TEXTS = ("survey", "dataset", "table", "date", "author", "description", "license")
LISTS = ("coauthors", "comments", "keywords")


@query("doc_headers", f"""WITH {I.DOCS_SQL} SELECT file, {', '.join(f'{scalar(k, "string", "VARCHAR")} AS "{k}"' for k in TEXTS)},
    {scalar('version', 'integer', 'BIGINT')} AS version, {scalar('MAML_version', 'number', 'DOUBLE')} AS maml_version,
    {', '.join(f'{joined(k, member(k))} AS {k}' for k in LISTS)},
    {joined('DOIs', pairs('DOIs', ('DOI', 'type')))} AS dois,
    {joined('depends', pairs('depends', ('survey', 'dataset', 'table', 'version')))} AS depends FROM docs""")
def doc_headers(spark, sf):
    """The typed header of every readable document, lists as text."""
    def flat(items, *names):
        return F.array_join(F.transform(items, lambda o: F.concat_ws("/", *[F.coalesce(o[n], F.lit("")) for n in names])), ",")

    rows = D.documents_to_headers(I.documents(spark, sf))
    return rows.select(
        "file", *TEXTS, "version", "maml_version", *[F.array_join(k, ",").alias(k) for k in LISTS],
        flat("dois", "doi", "doi_type").alias("dois"),
        flat("depends", "survey", "dataset", "table", "version").alias("depends"))


# --- history by file and table ---------------------------------------------------
#
# A customer's table is published every year that it has orders; its file has another name in some years,
# and in some its version is not recorded.

FILE = "CASE WHEN {year} % 5 = o_custkey % 5 THEN 'old_' ELSE '' END || 't' || CAST(o_custkey AS STRING) || '.parquet'"
YEAR = "CAST(year(CAST(o_orderdate AS DATE)) AS INT)"
HISTORY_SQL = f"""states AS MATERIALIZED (
    SELECT o_orderstatus AS dataset, o_custkey, {YEAR} AS release, sha1(CAST(max(o_orderkey) AS STRING)) AS sha1,
           CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY 1, 2, 3),
checksums AS (SELECT dataset, release, {FILE.format(year='release')} AS file, sha1 FROM states),
versions AS (SELECT dataset, release, 't' || CAST(o_custkey AS STRING) AS "table", n AS table_version FROM states
    WHERE (o_custkey + release) % 4 > 0),
local_files AS MATERIALIZED (SELECT s.dataset, 't' || CAST(o_custkey AS STRING) AS "table",
    't' || CAST(o_custkey AS STRING) || '.parquet' AS file, sha1(CAST(k AS STRING)) AS sha1
    FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), (VALUES ('F'), ('O'), ('P')) s(dataset)),
seen AS MATERIALIZED (SELECT l.dataset, l."table", l.file, c.release, c.sha1, v.table_version FROM local_files l
    JOIN checksums c ON c.dataset = l.dataset AND c.file = l.file
    JOIN versions v ON v.dataset = l.dataset AND v."table" = l."table" AND v.release = c.release
    QUALIFY row_number() OVER (PARTITION BY l.dataset, l."table", l.file ORDER BY c.release DESC) = 1)"""


def published(spark, sf):
    """Checksums by file, versions by table, and the local files."""
    orders = I.table(spark, sf, "orders")
    states = orders.groupBy(F.col("o_orderstatus").alias("dataset"), "o_custkey", F.expr(YEAR).alias("release")).agg(
        F.sha1(F.max("o_orderkey").cast("string")).alias("sha1"), F.count(F.lit(1)).cast("int").alias("n"))
    name = F.concat(F.lit("t"), F.col("o_custkey").cast("string"))
    checksums = states.select("dataset", "release", F.expr(FILE.format(year="release")).alias("file"), "sha1")
    versions = states.where("(o_custkey + release) % 4 > 0").select("dataset", "release", name.alias("table"), F.col("n").alias("table_version"))
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    local = latest.select(F.explode(F.array(*[F.lit(s) for s in "FOP"])).alias("dataset"), name.alias("table"),
                          F.concat(name, F.lit(".parquet")).alias("file"), F.sha1(F.col("k").cast("string")).alias("sha1"))
    return local, checksums, versions


@query("last_seen_by_file", f"WITH {HISTORY_SQL} SELECT * FROM seen")
def last_seen_by_file(spark, sf):
    return H.last_seen_by_file(*published(spark, sf))


@query("next_version_by_file", f"""WITH {HISTORY_SQL} SELECT l.dataset, l."table", CAST(CASE WHEN s.table_version IS NULL THEN 1
    WHEN s.sha1 = l.sha1 THEN s.table_version ELSE s.table_version + 1 END AS INTEGER) AS next_version
    FROM local_files l LEFT JOIN seen s ON s.dataset = l.dataset AND s."table" = l."table" AND s.file = l.file""")
def next_version_by_file(spark, sf):
    local, checksums, versions = published(spark, sf)
    return H.next_table_version(local, H.last_seen_by_file(local, checksums, versions))


# --- files written and read ------------------------------------------------------

@query("written_manifests", f"WITH {I.HASHES_SQL} SELECT dataset, name, sha1 FROM computed")
def written_manifests(spark, sf):
    """A manifest for each dataset, written under its name and read again."""
    folder = new_folder(spark)
    sinks.write_manifests(I.computed_hashes(spark, sf), folder)
    return manifests.read_manifests(spark, f"{folder}/*/*.checksums").select("dataset", "name", "sha1")


@query("written_rollups", f"""WITH {W.BUILD_CTE} SELECT dataset,
    max(value) FILTER (key = 'survey') AS survey, CAST(max(value) FILTER (key = 'version') AS BIGINT) AS version,
    max(value) FILTER (key = 'author') AS author, count(*) FILTER (key = 'coauthors') AS coauthors,
    count(*) FILTER (key = 'tables') AS tables, sum(version) FILTER (key = 'tables') AS versions FROM built GROUP BY 1""")
def written_rollups(spark, sf):
    """A rollup document for each dataset, written, parsed and opened again."""
    folder = new_folder(spark)
    sinks.write_rollups(W.built(spark, sf), folder)
    docs = D.open_documents(S.read_documents(spark, f"{folder}/*/*.daml"))
    tables = F.try_variant_get(D.value("tables"), "$", "array<struct<name:string,version:bigint>>")

    def text(key):
        return F.try_variant_get(D.value(key), "$", "string").alias(key)

    size = F.coalesce(F.size(F.try_variant_get(D.value("coauthors"), "$", "array<string>")), F.lit(0))
    return docs.select(
        text("dataset"), text("survey"), F.try_variant_get(D.value("version"), "$", "bigint").alias("version"), text("author"),
        size.cast("bigint").alias("coauthors"), F.size(tables).cast("bigint").alias("tables"),
        F.aggregate(tables, F.lit(0).cast("bigint"), lambda n, t: n + t["version"]).alias("versions"))


@query("written_skeletons", f"""WITH {N.INFERRED_SQL} SELECT "table", name, data_type, nullif(replace(unit, '--', ''), '') AS unit,
    lo IS NOT NULL AS has_range FROM inferred WHERE supported""")
def written_skeletons(spark, sf):
    """A skeleton document for each table, written, parsed and opened again."""
    folder = new_folder(spark)
    sinks.write_skeletons(N.inferred(spark, sf), N.DATE, folder)
    opened = D.open_documents(S.read_documents(spark, f"{folder}/*.maml"))
    return D.field_rows(opened).select(
        F.regexp_extract("file", r"([^/]*)\.maml$", 1).alias("table"), "name", "data_type", "unit",
        F.col("qc_min").isNotNull().alias("has_range"))


@query("listed_folders", f"""WITH {I.HASHES_SQL}, lists AS (SELECT dataset, '# Generated after a successful release check.' || chr(10)
        || '# Do not edit by hand.' || chr(10) || '# Upload together with the files of ' || dataset || '.' || chr(10)
        || string_agg(name || ': ' || sha1, chr(10) ORDER BY name) || chr(10) AS body FROM computed GROUP BY 1)
    SELECT dataset, dataset || '.checksums' AS name, dataset || '.checksums' AS stem, 'extra' AS kind,
           CAST(strlen(body) AS BIGINT) AS length, sha1(body) AS sha1 FROM lists""")
def listed_folders(spark, sf):
    """The release folders of all datasets, listed and hashed after their manifests are written."""
    folder, hashes = new_folder(spark), I.computed_hashes(spark, sf)
    sinks.write_manifests(hashes, folder)
    folders = [f"{folder}/{r.dataset}" for r in hashes.select("dataset").distinct().collect()]  # the folders' names
    return inventory.hashed_inventory(spark, folders).select("dataset", "name", "stem", "kind", "length", "sha1")


# --- rule files ------------------------------------------------------------------
#
# A rule file for each part: sound and faulty entries of every kind.

P = "CAST(p_partkey AS STRING)"
NL = "chr(10)"
RULE_TEXT = {
    "protected_words": f"'word_' || {P} || ':' || {NL} || '  common_mistakes: [wrd, \"' || p_brand || '\"]' || {NL} || '  ucd: [meta.id, x]' "
    f"|| CASE WHEN p_size % 3 = 0 THEN '' ELSE {NL} || '  unit: [' || CASE WHEN p_size % 3 = 1 THEN 'm' ELSE '1' END || ']' END",
    "filters": f"'f_' || {P} || ':' || {NL} || '  secondary_ucd: ' || CASE WHEN p_size % 4 = 0 THEN '[a]' ELSE 'em.opt' END || {NL} || 'g: ' "
    "|| CAST(p_size AS STRING)",
    "exceptions": f"'e_' || {P} || ': {{ucd: meta.id, unit: ' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE 'm' END || '}}'",
    "ucd_rules": f"'namespaces: [n' || {P} || ', ' || CASE WHEN p_size % 2 = 0 THEN '7' ELSE 'ivoa' END || ']'",
    "other": "'a: 1'",
}
RULE_KIND = I.choose("p_partkey % 5", I.quoted(*RULE_TEXT))
RULE_FILE = f"'p_' || {P} || '/' || {RULE_KIND} || '.yaml'"
ROW = 'SELECT {file} AS file, {kind} AS kind, {pos} AS pos, {name} AS name, {mistakes} AS mistakes, {unit} AS unit, {ucd} AS ucd, {error} AS error ' \
      "FROM part WHERE p_partkey % 5 = {at}"


def entry_sql(at, kind, pos, name, mistakes="NULL", unit="NULL", ucd="NULL", error="CAST(NULL AS VARCHAR)"):
    return ROW.format(file=RULE_FILE, kind=kind, pos=pos, name=name, mistakes=mistakes, unit=unit, ucd=ucd, error=error, at=at)


@query("src_rule_files", " UNION ALL ".join([
    entry_sql(0, "'protected'", 0, f"'word_' || {P}", "'wrd|' || p_brand", "CASE WHEN p_size % 3 = 1 THEN 'm' END", "'meta.id|x'",
              "CASE p_size % 3 WHEN 0 THEN 'unit is missing' WHEN 2 THEN 'unit must be list of strings' END"),
    entry_sql(1, "'filters'", 0, f"'f_' || {P}", ucd="CASE WHEN p_size % 4 = 0 THEN 'a' ELSE 'em.opt' END",
              error="CASE WHEN p_size % 4 = 0 THEN 'secondary_ucd must be string' END"),
    entry_sql(1, "'filters'", 1, "'g'", error="'must be mapping'"),
    entry_sql(2, "'exceptions'", 0, f"'e_' || {P}", unit="CASE WHEN p_size % 5 > 0 THEN 'm' END", ucd="'meta.id'",
              error="CASE WHEN p_size % 5 = 0 THEN 'unit is missing' END"),
    entry_sql(3, "'namespaces'", 0, f"'n' || {P}"),
    entry_sql(3, "'namespaces'", 1, "CASE WHEN p_size % 2 = 0 THEN '7' ELSE 'ivoa' END",
              error="CASE WHEN p_size % 2 = 0 THEN 'must be string' END"),
    entry_sql(4, "NULL", 0, "NULL", error="'no rule file of this name'")]))
def src_rule_files(spark, sf):
    text = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(RULE_TEXT.values())) + " END"
    texts = I.table(spark, sf, "part").select(F.expr(RULE_FILE).alias("file"), F.expr(text).alias("text"))
    rows = rulefiles.rule_entries(S.parse_documents(texts.repartition("file")))

    def flat(items):
        return F.array_join(items, "|")

    return rows.select("file", "kind", "pos", "name", flat("common_mistakes").alias("mistakes"), flat("unit").alias("unit"),
                       flat("ucd").alias("ucd"), "error")
