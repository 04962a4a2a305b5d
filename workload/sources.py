"""Readers and writers on texts and files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate.functions import kinds as K
from tablegate.operators import documents as D
from tablegate.sources import documents as S
from tablegate.sources import inventory, manifests, sinks
from tablegate.sources.vocabulary import parse_vocabulary
from workload import inference as N
from workload import inputs as I
from workload import rollups as W
from workload.registry import query

# --- documents ---------------------------------------------------------------

YAML_TEXT = "CASE " \
    "WHEN o_custkey % 9 = 0 THEN 'survey: [WAVES, ' || chr(10) || 'version: 1' " \
    "WHEN o_custkey % 9 = 1 THEN 'just text' " \
    "ELSE '# order' || chr(10) || 'survey: WAVES' || chr(10) || 'table: order_' || CAST(o_orderkey AS STRING) " \
    "|| chr(10) || 'version: ' || CAST(o_custkey AS STRING) || chr(10) || 'date: ' " \
    "|| CAST(CAST(o_orderdate AS DATE) AS STRING) || chr(10) || 'author: \"Customer <c@example.com>\"' " \
    "|| chr(10) || 'keywords:' || chr(10) || '- ' || o_orderpriority || chr(10) || '- \"' || o_orderstatus " \
    "|| '\"' || chr(10) || 'MAML_version: 1.1' || chr(10) || 'fields: .nan' END"


@query("src_documents", f"""SELECT {I.DOCUMENT_FILE} AS file,
    o_custkey % 9 > 1 AS is_read, CASE WHEN o_custkey % 9 > 1
        THEN 'survey,table,version,date,author,keywords,MAML_version,fields' END AS keys,
    CASE WHEN o_custkey % 9 > 1 THEN 'order_' || CAST(o_orderkey AS STRING) END AS "table",
    CASE WHEN o_custkey % 9 > 1 THEN CAST(o_custkey AS STRING) || ' integer' END AS version,
    CASE WHEN o_custkey % 9 > 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' string' END AS date,
    CASE WHEN o_custkey % 9 > 1 THEN o_orderpriority || '|' || o_orderstatus END AS keywords,
    CASE WHEN o_custkey % 9 > 1 THEN 'number number' END AS kinds FROM orders""")
def src_documents(spark, sf):
    orders = I.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").repartition("o_orderkey")
    texts = orders.select(
        F.expr(I.DOCUMENT_FILE).alias("file"), F.expr(YAML_TEXT).alias("text"))
    docs = D.open_documents(S.parse_documents(texts))

    def with_kind(key):
        return F.concat(K.as_text(D.value(key)), F.lit(" "), K.kind(D.value(key)))

    return docs.select(
        "file", F.col("parse_error").isNull().alias("is_read"),
        F.when(F.col("keys").isNotNull(), F.concat_ws(",", "keys")).alias("keys"),
        K.as_text(D.value("table")).alias("table"), with_kind("version").alias("version"),
        with_kind("date").alias("date"),
        F.array_join(F.try_variant_get(D.value("keywords"), "$", "array<string>"), "|").alias("keywords"),
        F.when(F.col("keys").isNotNull(), F.concat_ws(
            " ", K.kind(D.value("MAML_version")), K.kind(D.value("fields")))).alias("kinds"))


@query("src_vocabulary", f"""WITH {I.VOCAB_SQL} SELECT name, canonical, 'word of ' || length(name) AS descr,
    is_primary, is_secondary FROM vocab""")
def src_vocabulary(spark, sf):
    return parse_vocabulary(I.vocabulary_lines(spark, sf)).select(
        "name", "canonical", "descr", "is_primary", "is_secondary")


# --- manifests ---------------------------------------------------------------

MANIFEST_TEXT = f"text || chr(10) || '# comment: x' || chr(10) || ' : empty name' || chr(10) || 'empty hash: ' " \
    f"|| chr(10) || '  ' || {I.PARQUET} || ' :  ' || sha1(text) || CASE WHEN n_chars % 3 = 0 THEN chr(10) " \
    f"|| {I.PARQUET} || ': again:' || lang ELSE '' END"


@query("src_manifest", f"""WITH lines AS (SELECT doc_id, i, lines[i] AS line FROM (
        SELECT doc_id, string_split(replace({MANIFEST_TEXT}, chr(13), chr(10)), chr(10)) AS lines FROM documents),
        unnest(generate_series(1, len(lines))) AS g(i)),
    entries AS (SELECT doc_id, i, trim(regexp_extract(line, '^([^:]*):', 1), ' ' || chr(9)) AS name,
                       trim(regexp_extract(line, '^[^:]*:(.*)$', 1), ' ' || chr(9)) AS sha1
                FROM lines WHERE contains(line, ':') AND NOT regexp_matches(line, '^\\s*#'))
    SELECT doc_id, name, arg_max(sha1, i) AS sha1 FROM entries WHERE name <> '' AND sha1 <> '' GROUP BY 1, 2""")
def src_manifest(spark, sf):
    texts = I.table(spark, sf, "documents").select("doc_id", F.expr(MANIFEST_TEXT).alias("text"))
    return manifests.parse_manifest(manifests.text_lines(texts, ["doc_id"], "text"), ["doc_id"])


@query("sink_manifest", f"""WITH {I.HASHES_SQL}, datasets AS (SELECT DISTINCT dataset FROM computed)
    SELECT dataset, 0 AS line_group, '' AS name, '# Generated after a successful release check.' AS line FROM datasets
    UNION ALL SELECT dataset, 1, '', '# Do not edit by hand.' FROM datasets
    UNION ALL SELECT dataset, 2, '', '# Upload together with the files of ' || dataset || '.' FROM datasets
    UNION ALL SELECT dataset, 3, name, name || ': ' || sha1 FROM computed""")
def sink_manifest(spark, sf):
    return manifests.manifest_lines(I.computed_hashes(spark, sf))


@query("sha1_checksum", "SELECT page_id, sha1(html) AS sha1 FROM pages")
def sha1_checksum(spark, sf):
    content = F.encode("html", "UTF-8")
    return I.table(spark, sf, "pages").select("page_id", inventory.sha1_checksum(content).alias("sha1"))


@query("src_file_listing")
def src_file_listing(spark, sf):
    """The given folder's own files, hashed in full."""
    return inventory.file_listing(spark, [sf])


# --- sinks -------------------------------------------------------------------

@query("sink_rollup", f"""WITH {W.BUILD_CTE}
    SELECT dataset, section, order_file, order_pos, 0 AS line_no, key || ':' || coalesce(CASE key
        WHEN 'version' THEN ' ' || value ELSE ' "' || value || '"' END, '') AS line
    FROM built WHERE key NOT IN ('coauthors', 'tables')
    UNION ALL SELECT dataset, section, order_file, order_pos, 0, '- "' || value || '"' FROM built WHERE key = 'coauthors'
    UNION ALL SELECT dataset, section, order_file, order_pos, 0, '- name: "' || value || '"' FROM built WHERE key = 'tables'
    UNION ALL SELECT dataset, section, order_file, order_pos, 1, '  version: ' || version FROM built WHERE key = 'tables'
    UNION ALL SELECT DISTINCT dataset, section, '', -1, 0, key || ':' FROM built WHERE key IN ('coauthors', 'tables')""")
def sink_rollup(spark, sf):
    return sinks.rollup_lines(W.built(spark, sf))


@query("sink_skeleton", f"""WITH {N.INFERRED_SQL}, lines AS ({N.SKELETON_SQL})
    SELECT "table", count(*) AS n_lines, sum(length(line)) FILTER (WHERE line NOT LIKE '    m%') AS n_chars,
           count(*) FILTER (WHERE line LIKE '  qc:') AS n_ranges FROM lines GROUP BY 1""")
def sink_skeleton(spark, sf):
    """Size of the documents written: lines, text outside the bounds, ranges."""
    lines = sinks.skeleton_lines(N.inferred(spark, sf), N.DATE)
    return lines.groupBy("table").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(~F.col("line").like("    m%"), F.length("line"))).alias("n_chars"),
        F.count_if(F.col("line").like("  qc:")).alias("n_ranges"))


RENDERED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _width(column: str) -> str:
    return f"greatest((SELECT max(length(CAST({column} AS VARCHAR))) FROM customer), {len(column)})"


@query("sink_text_table", " UNION ALL ".join([
    "SELECT 0 AS part, CAST(NULL AS BIGINT) AS c_custkey, " + " || ' | ' || ".join(
        f"rpad('{c}', CAST({_width(c)} AS INTEGER), ' ')" for c in RENDERED) + " AS line",
    "SELECT 1, NULL, " + " || '-+-' || ".join(f"repeat('-', {_width(c)})" for c in RENDERED),
    "SELECT 2, c_custkey, " + " || ' | ' || ".join(
        f"rpad(CAST({c} AS VARCHAR), CAST({_width(c)} AS INTEGER), ' ')" for c in RENDERED) + " FROM customer"]))
def sink_text_table(spark, sf):
    return sinks.text_table(I.table(spark, sf, "customer").select(*RENDERED), ["c_custkey"])
