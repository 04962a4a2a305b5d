"""Inputs of the queries, derived from the given tables.

The tables hold no metadata, so names, documents, inventories and histories are
derived from their rows, with faults that depend on the keys.  Row expressions are
SQL text that both engines read; every input covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.functions.text import let
from tablegate.operators import documents as D
from tablegate.sources import inventory as I
from tablegate.sources import vocabulary as V

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def choose(key: str, values, otherwise: str | None = None) -> str:
    """``CASE key WHEN 0 THEN ... END`` over SQL fragments."""
    branches = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    tail = f" ELSE {otherwise}" if otherwise is not None else ""
    return f"CASE {key} {branches}{tail} END"


def quoted(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


# --- names -------------------------------------------------------------------

SEED_NAMES = quoted(
    "uberid", "SDSS_u", "mag_u_sdss", "W1_WISE", "ra_deg", "things", "wordz", "flux__density",
    "_mass", "mass_", "1st_mag", "r_sdsss", "bandx_vla", "K_VISTA_mag", "velocity", "r.a.", "M",
    "uberID", "Mstar_err", "dufff", "z_visto", "J_VISTAS", "fnu", "mag_abs", "ra", "dec_err",
    "flux_density_W2_WISE", "pos_ang", "u_SDSS", "uberID_ra_pix")
SEED = choose(f"p_partkey % {len(SEED_NAMES)}", SEED_NAMES)
PART_NAME = f"{SEED} || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_' || replace(p_name, ' ', '_') END"


def part_names(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.expr(PART_NAME).alias("name")).distinct()


PART_NAMES_SQL = f"part_names AS MATERIALIZED (SELECT DISTINCT {PART_NAME} AS name FROM part)"


def candidate_names(spark, sf) -> DataFrame:
    """Names to check: seeded names of parts, every word of every document, urls,
    customers."""
    words = table(spark, sf, "documents").select(
        F.explode_outer(F.split("text", "[ \n]+")).alias("name"))
    urls = table(spark, sf, "pages").select(F.col("url").alias("name"))
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return (part_names(spark, sf).unionByName(words).unionByName(urls).unionByName(customers)
            .filter("name <> ''").distinct())


NAMES_SQL = f"""{PART_NAMES_SQL}, names AS MATERIALIZED (
    SELECT DISTINCT name FROM (
        SELECT name FROM part_names
        UNION ALL SELECT unnest(string_split_regex(text, '[ \\n]+')) FROM documents
        UNION ALL SELECT url FROM pages
        UNION ALL SELECT c_name FROM customer) WHERE name <> '')"""


# --- metadata documents ------------------------------------------------------

K, C = "o_orderkey", "o_custkey"
KEY_TEXT, CUSTOMER_TEXT = f"CAST({K} AS STRING)", f"CAST({C} AS STRING)"


def entry(key: str, value: str, absent: str = "FALSE") -> str:
    return f"CASE WHEN {absent} THEN '' ELSE ', \"{key}\": ' || {value} END"


DATE_TEXT = "'\"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '\"'"
FIRST_FIELD = (
    "'{\"name\": \"o_orderkey\", \"unit\": \"--\", \"info\": \"key\", \"ucd\": \"meta.id\", "
    f"\"data_type\": \"int64\", \"qc\": {{\"min\": 0, \"max\": ' || {KEY_TEXT} || '}}}}'")
SECOND_FIELD = (
    "'{\"name\": \"o_totalprice\", \"unit\": ' || " + choose(
        f"{K} % 36", quoted('"usd"', '""', "null"), "'\"usd\"'")
    + " || ', \"info\": \"price\", \"ucd\": ' || " + choose(
        f"{K} % 30", quoted('"phot.mag;em.opt"', '"em.opt;phot.mag"', '"meta.id;what"', '"bad tag"'),
        "'\"phot.mag\"'")
    + " || ', \"data_type\": \"float64\"' || " + choose(f"{K} % 32", quoted(
        ', "qc": {"min": 0.5, "max": 9.5}', ', "qc": {"min": 0, "max": 9.5}', ', "qc": null',
        ', "qc": {"min": 0.5}', ', "qc": [1, 2]', ', "qc": {"min": 0.5, "max": 1.5, "step": 1}',
        ', "qc": {"min": true, "max": 2.5}', ""),
        "', \"qc\": {\"min\": 0.25, \"max\": 500000.5}'") + " || '}'")
THIRD_FIELD = (
    "'{\"name\": ' || " + choose(f"{K} % 28", quoted(
        '"o_orderkey"', '"SDSS_u"', '"_status"', '""'), "'\"o_orderstatus\"'")
    + " || ', \"unit\": \"--\", \"info\": \"state\", \"ucd\": \"meta.code\", \"data_type\": ' || "
    + choose(f"{K} % 36", quoted(
        '"text"', '"int32", "qc": {"min": 0.5, "max": 2}', '"boolean", "qc": {"min": 0, "max": 1}',
        'null', '"string", "extra": 1, "also": 2', '"int16", "qc": {"min": 1, "max": 2}'), "'\"string\"'")
    + " || '}'")
FIELDS = choose(
    f"{K} % 53", quoted("null", "[]", "{}", '["x", {}, null]'),
    f"'[' || {FIRST_FIELD} || ', ' || {SECOND_FIELD} || ', ' || {THIRD_FIELD} || ']'")
DESCRIPTION = entry("description", choose(
    f"{K} % 37", ["'null'", "'\"\"'", "'12'"], "'\"Order of priority ' || o_orderpriority || '\"'"))
COMMENTS = entry("comments", choose(
    f"{K} % 20", quoted("[]", '["ok", "", null, 0]'), "'[\"fine\"]'"), f"{K} % 5 = 2")
LICENSE = entry("license", choose(
    f"{K} % 41", quoted('"GPL"', "null", '["MIT"]', '"Copyright WAVES [Private]"'), "'\"MIT\"'"),
    f"{K} % 41 = 4")

RAW_DOCUMENT = " || ".join([
    "'{\"survey\": ' || " + choose(
        f"{K} % 29", quoted("null", "5"),
        "CASE o_orderstatus WHEN 'F' THEN '\"WAVES\"' WHEN 'O' THEN '\"WAVES-StePS\"' "
        f"ELSE CASE WHEN {C} % 2 = 0 THEN '\"SURVEY9\"' ELSE '\"WAVES-4C3R2\"' END END"),
    entry("dataset", choose(f"{C} % 39", quoted("null", '""', "17"),
                            "'\"' || lower(o_orderpriority) || '\"'"), f"{C} % 70 = 0"),
    entry("table", choose(f"{K} % 31", quoted('""', "null", "42"),
                          f"'\"order_' || CASE WHEN {C} % 11 = 0 THEN {CUSTOMER_TEXT} "
                          f"ELSE {KEY_TEXT} END || '\"'"), f"{K} % 31 = 3"),
    entry("version", choose(f"{K} % 19", quoted("1.0", "true", '"1"', "null"),
                            f"CAST({C} % 5 + 1 AS STRING)")),
    entry("date", choose(f"{K} % 23", quoted(
        '"19980131"', '"1998-02-30"', "19980101", '"1998-W05-3"', '"1998-W54"', '"soon"',
        '"1998W53"'), DATE_TEXT), f"{K} % 23 = 7"),
    entry("author", choose(f"{K} % 17", quoted(
        '"Customer"', '"A B <nobody>"', "null", '"X <a..b@example.com>"', "7",
        '"Y<y@example.c0>"'),
        f"'\"Customer ' || {CUSTOMER_TEXT} || ' <c' || {CUSTOMER_TEXT} || '@example.com>\"'")),
    entry("coauthors", choose(f"{K} % 26", quoted(
        "[]", '"solo"', '["bad", "Good One <g@x.org>", null, 3]', "null"),
        f"'[\"Co C <co' || {CUSTOMER_TEXT} || '@example.org>\"]'"), f"{K} % 13 = 4"),
    entry("DOIs", choose(f"{K} % 33", quoted(
        "[]", '[{"DOI": "10.1/a", "type": ""}, {}]',
        '[{"DOI": "", "type": "self", "y": 1, "x": 2}, 7]', '{"DOI": "x"}'),
        f"'[{{\"DOI\": \"10.1/' || {KEY_TEXT} || '\", \"type\": \"self\"}}]'"), f"{K} % 11 > 7"),
    entry("depends", choose(f"{K} % 35", quoted(
        '[{"survey": "WAVES", "dataset": "d", "table": "t"}]',
        '[null, {"survey": "WAVES", "dataset": "d", "table": "t", "version": 0, "extra": true}]',
        '"none"'),
        "'[{\"survey\": \"WAVES\", \"dataset\": \"d\", \"table\": \"t\", \"version\": \"1\"}]'"),
        f"{K} % 7 = 6"),
    f"CASE WHEN {K} % 15 = 0 THEN {LICENSE} || {DESCRIPTION} || {COMMENTS} "
    f"ELSE {DESCRIPTION} || {COMMENTS} || {LICENSE} END",
    entry("keywords", choose(f"{K} % 12", quoted('["a", ""]'), "'[\"a\"]'"), f"{K} % 3 = 2"),
    f"CASE WHEN {K} % 47 = 0 THEN ', \"notes\": \"x\", \"aux\": null' ELSE '' END",
    entry("MAML_version", choose(f"{K} % 43", quoted("1", '"1.1"', "1.0", "1.2"), "'1.1'")),
    entry("fields", FIELDS),
]) + " || '}'"

DOCUMENT_FILE = f"'order_' || {KEY_TEXT} || '.maml'"


def in_pieces(value):
    """The same value, bound once as a lambda variable.  A projection that holds a lambda is compiled in small
    methods; the text of a whole document beside it is else one method, too long for the JVM to compile."""
    return F.get(let(F.array(value), lambda held: held), F.lit(0))


def documents(spark, sf) -> DataFrame:
    """One metadata document per order: ``file, raw``."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_orderdate", "o_orderpriority")
    # A document is made, parsed and checked per order: dealt out by key, whatever the files.
    return orders.repartition("o_orderkey").select(
        in_pieces(F.expr(DOCUMENT_FILE)).alias("file"), F.expr(RAW_DOCUMENT).alias("raw"))


def opened(spark, sf, only: tuple[str, ...] | None = None) -> DataFrame:
    return D.open_documents(documents(spark, sf), only)


def opened_fields(spark, sf, parts: tuple[str, ...] | None = None) -> DataFrame:
    return D.open_fields(opened(spark, sf, ("fields",)), parts)


DOCS_SQL = f"""docs AS MATERIALIZED (
    SELECT {DOCUMENT_FILE} AS file, CAST({RAW_DOCUMENT} AS JSON) AS raw FROM orders)"""


# --- tags --------------------------------------------------------------------

WORD_TYPE = choose("length(word) % 5", quoted("P", "S", "Q", "E", "X"))

VOCAB_SQL = f"""bench_words AS (
    SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z0-9]+')) AS word FROM benchmark),
vocab AS MATERIALIZED (
    SELECT lower(word) AS name, max(word) AS canonical,
           bool_or({WORD_TYPE} IN ('Q', 'P', 'E', 'V', 'C')) AS is_primary,
           bool_or({WORD_TYPE} IN ('Q', 'S', 'E', 'V', 'C')) AS is_secondary
    FROM bench_words WHERE word <> '' GROUP BY 1)"""


def vocabulary_lines(spark, sf) -> DataFrame:
    """Vocabulary file lines from the benchmark's words."""
    words = table(spark, sf, "benchmark").select(
        F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("word")).filter("word <> ''").distinct()
    line = f"{WORD_TYPE} || ' | ' || word || ' | word of ' || CAST(length(word) AS STRING)"
    return words.select(F.expr(line).alias("value"))


def vocabulary(spark, sf) -> DataFrame:
    return V.parse_vocabulary(vocabulary_lines(spark, sf))


TAG = "replace(replace(line, ',', ''), ' ', ';')"


def line_tags(spark, sf) -> DataFrame:
    """A tag per line of every document: its words in order."""
    lines = table(spark, sf, "documents").select(
        "doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.expr(TAG).alias("ucd"))


TAGS_SQL = f"""tags AS MATERIALIZED (SELECT doc_id, {TAG} AS ucd FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"""


# --- inventories -------------------------------------------------------------

STEM = "'doc_' || CAST(doc_id AS STRING)"
FILE_RULES = (
    ("lang <> 'de'", f"{STEM} || '.parquet'"),
    ("lang <> 'es'", f"{STEM} || '.maml'"),
    ("lang = 'fr' OR n_chars % 9 = 0", f"{STEM} || '.md'"),
    ("n_chars > 6000", f"{STEM} || '.v2.txt'"),
    ("n_chars > 9000", "source || '.md'"),
    ("n_chars > 5000", "source || '.daml'"),
    ("lang = 'de'", "source || '.checksums'"),
)


def files(spark, sf) -> DataFrame:
    """Inventory of one folder per source: ``dataset, name, stem, kind``."""
    names = F.array(*[F.expr(f"CASE WHEN {rule} THEN {name} END") for rule, name in FILE_RULES])
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("dataset"), F.explode(F.array_compact(names)).alias("name"))
    return I.classify(rows.distinct())


FILES_SQL = "files AS MATERIALIZED (SELECT DISTINCT dataset, name, " \
    "regexp_replace(name, '\\.(maml|parquet|md)$', '') AS stem, " \
    "CASE WHEN regexp_extract(name, '([^.]*)$', 1) IN ('maml', 'parquet', 'md') " \
    "THEN regexp_extract(name, '([^.]*)$', 1) ELSE 'extra' END AS kind FROM (" \
    + " UNION ALL ".join(f"SELECT source AS dataset, {name} AS name FROM documents WHERE {rule}"
                         for rule, name in FILE_RULES) + "))"


# --- manifests ---------------------------------------------------------------

PARQUET = f"{STEM} || '.parquet'"


def expected_hashes(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").filter("lang <> 'es'").select(
        F.col("source").alias("dataset"), F.expr(PARQUET).alias("name"), F.sha1("text").alias("sha1"))


def computed_hashes(spark, sf) -> DataFrame:
    changed = F.expr("CASE WHEN n_chars % 5 = 0 THEN text || '.' ELSE text END")
    return table(spark, sf, "documents").filter("lang <> 'de'").select(
        F.col("source").alias("dataset"), F.expr(PARQUET).alias("name"), F.sha1(changed).alias("sha1"))


HASHES_SQL = f"""expected AS (
    SELECT source AS dataset, {PARQUET} AS name, sha1(text) AS sha1 FROM documents WHERE lang <> 'es'),
computed AS (
    SELECT source AS dataset, {PARQUET} AS name,
           sha1(CASE WHEN n_chars % 5 = 0 THEN text || '.' ELSE text END) AS sha1
    FROM documents WHERE lang <> 'de')"""


# --- history -----------------------------------------------------------------

def history_states(spark, sf) -> DataFrame:
    """A state per customer and year: hash of the latest order, order count as version."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(
        F.col("o_orderstatus").alias("dataset"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table"),
        F.year("o_orderdate").alias("release"),
    ).agg(F.max("o_orderkey").alias("k"), F.count(F.lit(1)).cast("int").alias("table_version")).select(
        "dataset", "table", "release", F.sha1(F.col("k").cast("string")).alias("sha1"), "table_version")


STATES_SQL = """states AS MATERIALIZED (
    SELECT o_orderstatus AS dataset, 't' || CAST(o_custkey AS STRING) AS "table",
           CAST(year(o_orderdate) AS INTEGER) AS release,
           sha1(CAST(max(o_orderkey) AS STRING)) AS sha1, CAST(count(*) AS INTEGER) AS table_version
    FROM orders GROUP BY 1, 2, 3)"""


def local_tables(spark, sf) -> DataFrame:
    """Local content per customer and status: the customer's latest order over all
    statuses decides, so some tables changed and some did not."""
    orders = table(spark, sf, "orders")
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    return latest.select(
        F.explode(F.array(*[F.lit(s) for s in ("F", "O", "P")])).alias("dataset"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table"),
        F.sha1(F.col("k").cast("string")).alias("sha1"),
        (F.col("o_custkey") % 4 + 1).cast("int").alias("version"))


LOCAL_SQL = """local_tables AS MATERIALIZED (
    SELECT s.dataset, 't' || CAST(o_custkey AS STRING) AS "table", sha1(CAST(k AS STRING)) AS sha1,
           CAST(o_custkey % 4 + 1 AS INTEGER) AS version
    FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1),
         (VALUES ('F'), ('O'), ('P')) s(dataset))"""


# --- rollups -----------------------------------------------------------------

DOC_SURVEY = "CASE WHEN c_nationkey % 3 = 0 THEN 'WAVES-StePS' WHEN c_custkey % 2 = 0 THEN 'WAVES' " \
    "ELSE 'WAVES-ORCHIDSS' END"
DOC_AUTHOR = "c_mktsegment || ' <' || lower(c_mktsegment) || '@example.com>'"


def table_documents(spark, sf) -> DataFrame:
    """One table document per customer, its nation as dataset."""
    customer = table(spark, sf, "customer")
    return customer.select(
        F.expr("'nation_' || CAST(c_nationkey AS STRING)").alias("dataset"),
        F.expr("c_name || '.maml'").alias("file"), F.expr(DOC_SURVEY).alias("survey"),
        F.col("c_name").alias("table"), F.expr("CAST(c_custkey % 4 + 1 AS INT)").alias("version"),
        F.expr(DOC_AUTHOR).alias("author"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE array(CAST(c_custkey % 7 AS STRING), "
               "c_mktsegment) END").alias("coauthors"),
        F.expr("CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'other' "
               "ELSE 'nation_' || CAST(c_nationkey AS STRING) END").alias("declared_dataset"))


TABLE_DOCS_SQL = f"""table_docs AS MATERIALIZED (
    SELECT 'nation_' || CAST(c_nationkey AS STRING) AS dataset, c_name || '.maml' AS file,
           {DOC_SURVEY} AS survey, c_name AS "table", CAST(c_custkey % 4 + 1 AS INTEGER) AS version,
           {DOC_AUTHOR} AS author,
           CASE WHEN c_custkey % 5 = 0 THEN NULL
                ELSE [CAST(c_custkey % 7 AS STRING), c_mktsegment] END AS coauthors,
           CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'other'
                ELSE 'nation_' || CAST(c_nationkey AS STRING) END AS declared_dataset
    FROM customer)"""


def release_folders(spark, sf) -> DataFrame:
    """Release folders per dataset from the suppliers of a nation."""
    return table(spark, sf, "supplier").select(
        F.expr("'nation_' || CAST(s_nationkey AS STRING)").alias("dataset"),
        F.expr(choose("s_suppkey % 5", quoted("vx", "notes", "v1.5"),
                      "'v' || CAST(s_suppkey % 17 AS STRING)")).alias("folder"))


FOLDERS_SQL = "folders AS (SELECT 'nation_' || CAST(s_nationkey AS STRING) AS dataset, " + choose(
    "s_suppkey % 5", quoted("vx", "notes", "v1.5"), "'v' || CAST(s_suppkey % 17 AS STRING)") \
    + " AS folder FROM supplier)"

S = "s_suppkey"
SUPPLIER_TABLES = "'[' || " + " || ".join(
    [f"CASE WHEN {S} % 4 >= {i} THEN '{', ' if i else ''}{{\"name\": \"t{i + 1}\", \"version\": ' || "
     f"CAST(({S} + {i}) % 3 + 1 AS STRING) || '}}' ELSE '' END" for i in range(4)]) + " || ']'"
RAW_ROLLUP = " || ".join([
    "'{\"survey\": \"WAVES\"'",
    entry("dataset", choose(f"{S} % 9", quoted("null", '"elsewhere"', "3"),
                            f"'\"supplier_' || CAST({S} AS STRING) || '\"'")),
    entry("version", choose(f"{S} % 6", quoted("1", "2", '"3"', "null", "3.0"), "'4'")),
    entry("date", "'\"2024-05-06\"'"),
    entry("author", "'\"' || s_name || ' <s@example.com>\"'"),
    entry("description", choose(f"{S} % 8", quoted("null"), "'\"Parts\"'")),
    entry("license", "'\"MIT\"'"),
    entry("ancillary", "'\"\"'", f"{S} % 10 <> 0"),
    entry("tables", SUPPLIER_TABLES, f"{S} % 12 = 0"),
]) + " || '}'"
ROLLUP_DATASET = f"'supplier_' || CAST({S} AS STRING)"


def rollup_documents(spark, sf) -> DataFrame:
    """One rollup document per supplier: ``dataset, file, raw``."""
    return table(spark, sf, "supplier").select(
        F.expr(ROLLUP_DATASET).alias("dataset"), F.expr(f"{ROLLUP_DATASET} || '.daml'").alias("file"),
        F.expr(RAW_ROLLUP).alias("raw"))


ROLLUPS_SQL = f"""rollups AS MATERIALIZED (
    SELECT {ROLLUP_DATASET} AS dataset, {ROLLUP_DATASET} || '.daml' AS file,
           CAST({RAW_ROLLUP} AS JSON) AS raw FROM supplier)"""


def supplier_tables(spark, sf) -> DataFrame:
    """Tables the documents declare per supplier, from its line items."""
    return table(spark, sf, "lineitem").groupBy(
        F.expr("'supplier_' || CAST(l_suppkey AS STRING)").alias("dataset"),
        F.expr("'t' || CAST(l_linenumber AS STRING)").alias("name"),
    ).agg(F.expr("CAST(min(l_suppkey + l_linenumber) % 4 AS INT)").alias("version"))


SUPPLIER_TABLES_SQL = """supplier_tables AS MATERIALIZED (
    SELECT 'supplier_' || CAST(l_suppkey AS STRING) AS dataset,
           't' || CAST(l_linenumber AS STRING) AS name,
           CAST(min(l_suppkey + l_linenumber) % 4 AS INTEGER) AS version
    FROM lineitem GROUP BY 1, 2)"""


def supplier_releases(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.expr(ROLLUP_DATASET).alias("dataset"),
        F.expr(f"CAST({S} % 4 + 1 AS INT)").alias("next_release"))


SUPPLIER_RELEASES_SQL = f"""releases AS (
    SELECT {ROLLUP_DATASET} AS dataset, CAST({S} % 4 + 1 AS INTEGER) AS next_release FROM supplier)"""
