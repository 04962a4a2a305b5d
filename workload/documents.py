"""Document checks over the metadata documents derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate import rules as R
from tablegate.functions.findings import all_of, explode_findings
from tablegate.functions.lint import lint_findings
from tablegate.operators import documents as D
from tablegate.operators import tags as T
from tablegate.sources.store import stored
from workload import inputs as I
from workload import names as W
from workload.registry import query

FAIL = "CAST(2 AS TINYINT)"


def texts(items) -> str:
    return "(" + ", ".join(W.literal(i) for i in items) + ")"


def text_list(items) -> str:
    return "[" + ", ".join(W.literal(i) for i in items) + "]"


def kind(value: str) -> str:
    """Kind of a JSON value (SQL NULL counts as null)."""
    return (f"CASE coalesce(json_type({value}), 'NULL') WHEN 'NULL' THEN 'null' "
            "WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' "
            "WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END")


def at(key: str, value: str = "raw") -> str:
    return f"json_extract({value}, '$.{key}')"


def text(value: str) -> str:
    return f"json_extract_string({value}, '$')"


def falsy(value: str) -> str:
    return f"(coalesce(CAST({value} AS VARCHAR), 'null') IN ('null', '\"\"', 'false', '[]', '{{}}', '0', '0.0'))"


def blank(value: str) -> str:
    return f"(coalesce(CAST({value} AS VARCHAR), 'null') IN ('null', '\"\"', '[]', '{{}}'))"


def found(check: str, condition: str, message: str, source: str = "docs") -> str:
    return (f"SELECT file, '{check}' AS \"check\", {FAIL} AS severity, {message} AS message "
            f"FROM {source} WHERE {condition}")


def required(check, key):
    return found(check, f"{kind(at(key))} = 'null'", f"'{key} is missing'")


def has_kind(check, key, expected):
    return found(check, f"{kind(at(key))} NOT IN ('{expected}', 'null')",
                 f"'{key} must be {expected}, got ' || {kind(at(key))}")


def required_kind(check, key, expected):
    return [required(check, key), has_kind(check, key, expected)]


def optional_list(check, key):
    return [found(check, f"{kind(at(key))} NOT IN ('list', 'null')",
                  f"'{key} must be list, got ' || {kind(at(key))}"),
            found(check, f"CAST({at(key)} AS VARCHAR) = '[]'", f"'{key} is an empty list'")]


def one_of(check, key, allowed):
    return [*required_kind(check, key, "string"),
            found(check, f"{kind(at(key))} = 'string' AND {text(at(key))} NOT IN {texts(allowed)}",
                  f"'{key} not accepted: ' || {text(at(key))}")]


def non_empty(check, key):
    return [*required_kind(check, key, "string"),
            found(check, f"CAST({at(key)} AS VARCHAR) = '\"\"'", f"'{key} is missing'")]


EMAIL = (r"^[\p{L}\p{N}!#$%&''*+\-/=?^_`{|}~]+(\.[\p{L}\p{N}!#$%&''*+\-/=?^_`{|}~]+)*"
         r"@([\p{L}\p{N}]([\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?\.)+"
         r"[\p{L}\p{N}]([\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?$")
AUTHOR = r"^.+?\s*<([^>]+)>$"


def author_problem(value: str) -> str:
    email = f"regexp_extract({value}, '{AUTHOR}', 1)"
    return (f"CASE WHEN NOT regexp_matches({value}, '{AUTHOR}') THEN 'not ''Name <address>'': ' "
            f"WHEN NOT (regexp_matches({email}, '{EMAIL}') AND regexp_matches({email}, '\\p{{L}}$') "
            f"AND length(split_part({email}, '@', 1)) <= 64 AND length({email}) <= 254) "
            "THEN 'not a mail address: ' END")


def elements(key: str) -> str:
    """Rows (file, pos, item) of a list value."""
    return (f"(SELECT file, i + 1 AS pos, json_extract({at(key)}, '$[' || i || ']') AS item "
            f"FROM docs, unnest(range(0, CAST(coalesce(json_array_length({at(key)}), 0) AS BIGINT))) AS g(i) "
            f"WHERE {kind(at(key))} = 'list')")


DATE = text(at("date"))
ISO_DATE = f"""(CASE
    WHEN regexp_matches({DATE}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime({DATE}, '%Y-%m-%d') IS NOT NULL
    WHEN regexp_matches({DATE}, '^\\d{{8}}$') THEN try_strptime({DATE}, '%Y%m%d') IS NOT NULL
    WHEN regexp_matches({DATE}, '^(\\d{{4}}-W\\d{{2}}(-[1-7])?|\\d{{4}}W\\d{{2}}[1-7]?)$')
    THEN CAST(regexp_extract({DATE}, 'W(\\d{{2}})', 1) AS INTEGER) BETWEEN 1 AND
         week(make_date(CAST({DATE}[1:4] AS INTEGER), 12, 28))
    ELSE FALSE END)"""


def filled(check, key):
    return [*optional_list(check, key),
            found(check, falsy("item"), f"'{key}[' || pos || ']: empty'", elements(key))]


def object_list(check, key, keys):
    label = f"'{key}[' || pos || ']: ' || "
    usable = f"NOT {falsy('item')} AND {kind('item')} = 'object'"
    source = elements(key)
    extra = f"list_sort(list_filter(json_keys(item), lambda k: k NOT IN {texts(keys)}))"
    return [
        *optional_list(check, key),
        found(check, falsy("item"), label + "'empty'", source),
        found(check, f"NOT {falsy('item')} AND {kind('item')} <> 'object'", label + "'must be object'", source),
        *[found(check, f"{usable} AND {falsy(at(k, 'item'))}", label + f"'{k} is missing'", source)
          for k in keys],
        found(check, f"{usable} AND len({extra}) > 0",
              label + f"'unexpected ' || array_to_string({extra}, ', ')", source)]


KEYS = "json_keys(raw)"
EXTRA = f"list_sort(list_filter({KEYS}, lambda k: k NOT IN {texts(R.DOCUMENT_KEYS)}))"
EXPECTED = f"list_filter({text_list(R.DOCUMENT_KEYS)}, lambda k: list_contains({KEYS}, k))"
ACTUAL = f"list_filter({KEYS}, lambda k: k IN {texts(R.DOCUMENT_KEYS)})"
OPTIONAL = [k for k in (*R.DOCUMENT_KEYS, "notes", "aux") if k not in R.DOCUMENT_REQUIRED]
BLANKS = "list_filter([" + ", ".join(
    f"CASE WHEN list_contains({KEYS}, '{k}') AND {blank(at(k))} THEN '{k}' END" for k in (
        "coauthors", "DOIs", "depends", "comments", "keywords", "notes", "aux")) + "], lambda k: k IS NOT NULL)"

FIELDS_SQL = f"""fields AS MATERIALIZED (
    SELECT file, pos, item, {falsy('item')} AS is_empty, {kind('item')} AS item_kind,
           CASE WHEN {kind('item')} = 'object' AND NOT {falsy(at('name', 'item'))}
                THEN {text(at('name', 'item'))} END AS name,
           CASE WHEN {kind('item')} = 'object' AND NOT {falsy(at('data_type', 'item'))}
                THEN {text(at('data_type', 'item'))} END AS data_type,
           CASE WHEN {kind('item')} = 'object' AND NOT {falsy(at('ucd', 'item'))}
                THEN {text(at('ucd', 'item'))} END AS ucd,
           CASE WHEN {kind('item')} = 'object' THEN {at('qc', 'item')} END AS qc,
           CASE WHEN {kind('item')} = 'object' THEN list_contains(json_keys(item), 'qc') END AS has_qc
    FROM {elements('fields')})"""
USABLE = "NOT is_empty AND item_kind = 'object'"
LABEL = "'fields[' || pos || ']: ' || "
FIELD_EXTRA = f"list_sort(list_filter(json_keys(item), lambda k: k NOT IN {texts(R.FIELD_KEYS)}))"
QC_EXTRA = "list_sort(list_filter(json_keys(qc), lambda k: k NOT IN ('min', 'max')))"
QC_OBJECT = f"has_qc AND NOT {blank('qc')} AND {kind('qc')} = 'object'"
LOW, HIGH = kind(at("min", "qc")), kind(at("max", "qc"))
QC_MISSING = f"list_filter([CASE WHEN {LOW} = 'null' THEN 'min' END, " \
             f"CASE WHEN {HIGH} = 'null' THEN 'max' END], lambda k: k IS NOT NULL)"
COMPLETE = f"{QC_OBJECT} AND len({QC_MISSING}) = 0"


def field_found(check, condition, message):
    return found(check, condition, LABEL + message, "fields")


# Every document check as SQL over the docs (and fields) CTEs.
SQL = {
    "doc_required": [required("doc_required", k) for k in R.DOCUMENT_REQUIRED],
    "doc_type": [has_kind("doc_type", k, "string") for k in (
        "survey", "dataset", "table", "date", "author", "description", "license")],
    "doc_optional_list": [q for k in ("coauthors", "DOIs", "depends", "comments", "keywords")
                          for q in optional_list("doc_optional_list", k)],
    "doc_empty_optionals": [found("doc_empty_optionals", f"len({BLANKS}) > 0",
                                  f"'present but empty: ' || array_to_string({BLANKS}, ', ')")],
    "doc_survey": one_of("doc_survey", "survey", R.SURVEYS),
    "doc_license": one_of("doc_license", "license", R.LICENSES),
    "doc_description": required_kind("doc_description", "description", "string"),
    "doc_author": [*required_kind("doc_author", "author", "string"), found(
        "doc_author", f"{kind(at('author'))} = 'string' AND ({author_problem(text(at('author')))}) IS NOT NULL",
        f"({author_problem(text(at('author')))}) || {text(at('author'))}")],
    "doc_coauthors": [
        *optional_list("doc_coauthors", "coauthors"),
        f"SELECT file, 'doc_coauthors' AS \"check\", {FAIL} AS severity, "
        f"'coauthors[' || pos || ']: ' || problem AS message FROM (SELECT file, pos, "
        f"CASE WHEN {kind('item')} = 'null' THEN 'missing' WHEN {kind('item')} <> 'string' THEN 'must be string' "
        f"ELSE ({author_problem(text('item'))}) || {text('item')} END AS problem FROM {elements('coauthors')}) "
        "WHERE problem IS NOT NULL"],
    "doc_date": [*required_kind("doc_date", "date", "string"), found(
        "doc_date", f"{kind(at('date'))} = 'string' AND NOT {ISO_DATE}", f"'not an ISO date: ' || {DATE}")],
    "doc_key_order": [found("doc_key_order", f"{EXPECTED} <> {ACTUAL}",
                            f"'expected order: ' || array_to_string({EXPECTED}, ', ')")],
    "doc_no_extra_keys": [found("doc_no_extra_keys", f"len({EXTRA}) > 0",
                                f"'unexpected: ' || array_to_string({EXTRA}, ', ')")],
    "doc_dataset": non_empty("doc_dataset", "dataset"),
    "doc_table": non_empty("doc_table", "table"),
    "doc_table_matches_file": [found(
        "doc_table_matches_file",
        f"(CASE WHEN {kind(at('table'))} = 'string' THEN {text(at('table'))} END) "
        "IS DISTINCT FROM replace(file, '.maml', '')",
        "'table should be ' || replace(file, '.maml', '')")],
    "doc_version_int": required_kind("doc_version_int", "version", "integer"),
    "doc_schema_version": [*required_kind("doc_schema_version", "MAML_version", "number"), found(
        "doc_schema_version", f"{kind(at('MAML_version'))} = 'number' AND "
        f"CAST({text(at('MAML_version'))} AS DOUBLE) <> 1.1", "'MAML_version should be 1.1'")],
    "doc_dois": object_list("doc_dois", "DOIs", R.DOI_KEYS),
    "doc_depends": object_list("doc_depends", "depends", R.DEPENDS_KEYS),
    "doc_comments": filled("doc_comments", "comments"),
    "doc_keywords": filled("doc_keywords", "keywords"),
    "fields_shape": [
        required("fields_shape", "fields"), *optional_list("fields_shape", "fields"),
        field_found("fields_shape", "is_empty", "'empty'"),
        field_found("fields_shape", "NOT is_empty AND item_kind <> 'object'", "'must be object'")],
    "fields_required": [field_found("fields_required", f"{USABLE} AND {falsy(at(k, 'item'))}",
                                    f"'{k} is missing'") for k in R.FIELD_REQUIRED],
    "fields_duplicates": [
        f"SELECT file, 'fields_duplicates' AS \"check\", {FAIL} AS severity, "
        "'fields[' || pos || ']: ' || name || ' repeats ' || earlier AS message FROM ("
        "SELECT a.file, a.pos, a.name, string_agg(CAST(b.pos AS VARCHAR), ',' ORDER BY b.pos) AS earlier "
        "FROM fields a JOIN fields b ON a.file = b.file AND a.name = b.name AND b.pos < a.pos "
        "GROUP BY ALL)"],
    "fields_data_type": [field_found(
        "fields_data_type", f"{USABLE} AND data_type NOT IN {texts(R.DATA_TYPES)}",
        "'unknown data_type ' || data_type")],
    "fields_extra_keys": [field_found("fields_extra_keys", f"{USABLE} AND len({FIELD_EXTRA}) > 0",
                                      f"'unexpected ' || array_to_string({FIELD_EXTRA}, ', ')")],
    "fields_qc": [
        field_found("fields_qc", f"{USABLE} AND has_qc AND {blank('qc')}", "'qc is empty'"),
        field_found("fields_qc", f"{USABLE} AND has_qc AND NOT {blank('qc')} AND {kind('qc')} <> 'object'",
                    "'qc must be object'"),
        field_found("fields_qc", f"{USABLE} AND {QC_OBJECT} AND len({QC_EXTRA}) > 0",
                    f"'qc has unexpected ' || array_to_string({QC_EXTRA}, ', ')"),
        field_found("fields_qc", f"{USABLE} AND {QC_OBJECT} AND len({QC_MISSING}) > 0",
                    f"'qc lacks ' || array_to_string({QC_MISSING}, ', ')"),
        field_found("fields_qc", f"{USABLE} AND {COMPLETE} AND data_type NOT IN "
                    f"{texts((*R.INTEGER_TYPES, *R.FLOAT_TYPES))}", "'qc on non-numeric type ' || data_type"),
        field_found("fields_qc", f"{USABLE} AND {COMPLETE} AND data_type IN {texts(R.INTEGER_TYPES)} "
                    f"AND ({LOW} = 'number' OR {HIGH} = 'number')", "'float qc on an integer field'"),
        field_found("fields_qc", f"{USABLE} AND {COMPLETE} AND data_type IN {texts(R.FLOAT_TYPES)} "
                    f"AND ({LOW} = 'integer' OR {HIGH} = 'integer')", "'integer qc on a float field'")],
}

CHECKS = {
    "doc_required": lambda: all_of(*[D.required(k) for k in R.DOCUMENT_REQUIRED]),
    "doc_type": lambda: all_of(*[D.has_kind(k, "string") for k in (
        "survey", "dataset", "table", "date", "author", "description", "license")]),
    "doc_optional_list": lambda: all_of(*[D.optional_list(k) for k in (
        "coauthors", "DOIs", "depends", "comments", "keywords")]),
    "doc_empty_optionals": D.empty_optionals,
    "doc_survey": D.survey,
    "doc_license": D.license_name,
    "doc_description": D.description,
    "doc_author": D.author,
    "doc_coauthors": D.coauthors,
    "doc_date": D.date,
    "doc_key_order": D.key_order,
    "doc_no_extra_keys": D.no_extra_keys,
    "doc_dataset": D.dataset,
    "doc_table": D.table,
    "doc_table_matches_file": D.table_matches_file,
    "doc_version_int": D.version_int,
    "doc_schema_version": D.schema_version,
    "doc_dois": D.dois,
    "doc_depends": D.depends,
    "doc_comments": D.comments,
    "doc_keywords": D.keywords,
    "fields_shape": D.fields_shape,
    "fields_required": D.fields_required,
    "fields_duplicates": D.fields_duplicates,
    "fields_data_type": D.fields_data_type,
    "fields_extra_keys": D.fields_extra_keys,
    "fields_qc": D.fields_qc,
}

DOC_CTE = f"WITH {I.DOCS_SQL}, {FIELDS_SQL} "


def union(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# The keys that a check of few keys reads, and the parts of a field that a check of fields does.
KEYS_READ = {f"doc_{key}": (key,) for key in (
    "survey", "license", "description", "author", "coauthors", "date", "dataset", "table", "depends", "comments", "keywords")}
KEYS_READ |= {"doc_dois": ("DOIs",), "doc_version_int": ("version",), "doc_schema_version": ("MAML_version",),
              "doc_table_matches_file": ("table",)}
PARTS_READ = {
    "fields_shape": (), "fields_required": ("missing",), "fields_duplicates": ("name",), "fields_data_type": ("data_type",),
    "fields_extra_keys": ("keys",),
    "fields_qc": ("keys", "data_type", "qc_blank", "qc_is_object", "qc_keys", "min_kind", "max_kind")}

for _name, _check in CHECKS.items():
    def _run(spark, sf, name=_name, check=_check):
        rows = I.opened_fields(spark, sf, PARTS_READ[name]) if name in PARTS_READ else I.opened(spark, sf, KEYS_READ.get(name))
        return explode_findings(rows, ["file"], check())
    query(_name, DOC_CTE + union(SQL[_name]))(_run)


@query("doc_enum", DOC_CTE + union(one_of("doc_enum", "survey", R.SURVEYS)
                                   + one_of("doc_enum", "license", R.LICENSES)))
def doc_enum(spark, sf):
    return explode_findings(I.opened(spark, sf), ["file"],
                            D.one_of("survey", R.SURVEYS, "doc_enum"),
                            D.one_of("license", R.LICENSES, "doc_enum"))


FIELD_NAMES_SQL = f"""{I.DOCS_SQL}, {FIELDS_SQL}, {W.RULE_TABLES},
    names AS MATERIALIZED (SELECT DISTINCT name FROM fields WHERE name IS NOT NULL),
    bad_names AS MATERIALIZED ({union(W.RULE_SQL.values())})"""
FIELD_NAME_FINDINGS = """SELECT file, 'fields_names' AS "check", severity, name || ': ' || message AS message
    FROM fields JOIN bad_names USING (name)"""


@query("fields_names", f"WITH {FIELD_NAMES_SQL} {FIELD_NAME_FINDINGS}")
def fields_names(spark, sf):
    return D.field_name_findings(I.opened(spark, sf, ("fields",)))


def tag_problems(source: str) -> str:
    """First problem per distinct tag of ``source`` against the vocab CTE."""
    illegal = "regexp_extract(ucd, '[^A-Za-z0-9_.;\\-]', 0)"
    return f"""SELECT ucd, arg_min(message, pos) AS message FROM (
        SELECT ucd, -1 AS pos, 'invalid character ' || {illegal} AS message FROM {source} WHERE {illegal} <> ''
        UNION ALL SELECT ucd, pos, CASE
            WHEN NOT regexp_matches(word, '^[A-Za-z0-9]') THEN 'invalid word ' || word
            WHEN pos = 1 AND NOT p AND s THEN 'not a primary word: ' || word
            WHEN pos = 1 AND NOT p THEN 'unknown word ' || word
            WHEN pos > 1 AND NOT s AND p THEN 'not a secondary word: ' || word
            WHEN pos > 1 AND NOT s THEN 'unknown word ' || word END
        FROM (SELECT ucd, pos, word, coalesce(is_primary, FALSE) AS p, coalesce(is_secondary, FALSE) AS s
              FROM (SELECT ucd, pos, words[pos] AS word FROM (
                        SELECT ucd, string_split(ucd, ';') AS words FROM {source} WHERE {illegal} = ''),
                    unnest(generate_series(1, len(words))) AS g(pos))
              LEFT JOIN vocab ON lower(word) = vocab.name))
        WHERE message IS NOT NULL GROUP BY ucd"""


@query("ucd_validate", f"""WITH {I.VOCAB_SQL}, {I.TAGS_SQL},
    distinct_tags AS (SELECT DISTINCT ucd FROM tags WHERE ucd <> '')
    {tag_problems('distinct_tags')}""")
def ucd_validate(spark, sf):
    return T.ucd_validate(I.line_tags(spark, sf), I.vocabulary(spark, sf))


@query("vocab_join", f"""WITH {I.VOCAB_SQL}, {I.TAGS_SQL}
    SELECT word, coalesce(is_primary, FALSE) AS is_primary, coalesce(is_secondary, FALSE) AS is_secondary,
           n FROM (SELECT word, count(*) AS n FROM (
               SELECT unnest(string_split(ucd, ';')) AS word FROM tags) GROUP BY 1)
    LEFT JOIN vocab ON lower(word) = vocab.name""")
def vocab_join(spark, sf):
    words = I.line_tags(spark, sf).select(F.explode(F.split("ucd", ";")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return T.vocab_join(counted, I.vocabulary(spark, sf))


# Tag words the documents use, by the parts that would carry them.
FIELD_VOCAB = (("meta.id", "Q"), ("phot.mag", "E"), ("em.opt", "S"), ("meta.code", "P"))
FIELD_VOCAB_NAME = I.choose("p_partkey % 4", I.quoted(*[w for w, _ in FIELD_VOCAB]))
FIELD_VOCAB_TYPE = I.choose("p_partkey % 4", I.quoted(*[t for _, t in FIELD_VOCAB]))
FIELD_VOCAB_SQL = f"""vocab AS (SELECT DISTINCT {FIELD_VOCAB_NAME} AS name,
    {FIELD_VOCAB_TYPE} IN ('Q', 'P', 'E', 'V', 'C') AS is_primary,
    {FIELD_VOCAB_TYPE} IN ('Q', 'S', 'E', 'V', 'C') AS is_secondary FROM part)"""


def field_vocabulary(spark, sf):
    from tablegate.sources.vocabulary import vocabulary
    return vocabulary(I.table(spark, sf, "part").select(
        F.expr(FIELD_VOCAB_TYPE).alias("type"), F.expr(FIELD_VOCAB_NAME).alias("name"),
        F.lit("").alias("descr")).distinct())


SUITE = ("doc_survey", "doc_dataset", "doc_table", "doc_table_matches_file", "doc_version_int",
         "doc_date", "doc_author", "doc_coauthors", "doc_dois", "doc_depends", "doc_description",
         "doc_comments", "doc_license", "doc_keywords", "doc_schema_version", "fields_shape",
         "fields_required", "fields_duplicates", "fields_data_type", "fields_qc",
         "fields_extra_keys", "doc_no_extra_keys", "doc_empty_optionals", "doc_key_order")
SUITE_CTE = f"""WITH {FIELD_NAMES_SQL}, {FIELD_VOCAB_SQL},
    field_tags AS (SELECT DISTINCT ucd FROM fields WHERE ucd IS NOT NULL),
    bad_tags AS ({tag_problems('field_tags')}),
    findings AS MATERIALIZED ({union([q for name in SUITE for q in SQL[name]])}
        UNION ALL ({FIELD_NAME_FINDINGS})
        UNION ALL (SELECT file, 'ucd_validate', {FAIL}, 'fields[' || pos || ']: ' || message
                   FROM fields JOIN bad_tags USING (ucd)))"""


@query("validate_documents", SUITE_CTE + " SELECT * FROM findings")
def validate_documents(spark, sf):
    return D.validate_documents(I.documents(spark, sf), field_vocabulary(spark, sf))


@query("documents_to_fields", SUITE_CTE + f""", valid AS (
        SELECT file, raw FROM docs WHERE file NOT IN (SELECT file FROM findings WHERE severity = 2))
    SELECT {text(at('table'))} AS "table", name AS "column", pos, {text(at('unit', 'item'))} AS unit,
           ucd, data_type, CAST({at('min', 'qc')} AS VARCHAR) AS qc_min,
           CAST({at('max', 'qc')} AS VARCHAR) AS qc_max FROM fields JOIN valid USING (file)""")
def documents_to_fields(spark, sf):
    docs = stored(D.typed_documents(I.documents(spark, sf)).drop("header"))  # read twice, opened once; headers are not asked for
    findings = D.validate_documents(docs, field_vocabulary(spark, sf))
    return D.documents_to_fields(docs, findings).select(
        "table", "column", "pos", "unit", "ucd", "data_type", "qc_min", "qc_max")


@query("fields_accessors", f"""WITH {I.DOCS_SQL}, {FIELDS_SQL}, wanted AS (
        SELECT 'order_' || CAST(l_orderkey AS STRING) || '.maml' AS "table",
               CASE WHEN l_returnflag = 'R' THEN 'o_totalprice' WHEN l_returnflag = 'A' THEN 'o_orderkey'
                    ELSE 'absent' END AS "column" FROM lineitem GROUP BY ALL),
    have AS (SELECT file AS "table", name AS "column", CASE WHEN name = 'o_totalprice' THEN 'money'
             ELSE {text(at('unit', 'item'))} END AS unit FROM fields WHERE name IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY pos DESC) = 1)
    SELECT w."table", w."column", h.unit AS value, h."column" IS NOT NULL AS known
    FROM wanted w LEFT JOIN have h ON w."table" = h."table" AND w."column" = h."column" """)
def fields_accessors(spark, sf):
    """Set the unit of one column everywhere, then read the units of the wanted ones."""
    rows = D.field_rows(I.opened(spark, sf, ("fields",)), ("name", "unit")).filter(F.col("name").isNotNull())
    fields = stored(rows.groupBy(F.col("file").alias("table"), F.col("name").alias("column")).agg(
        F.max_by("unit", "pos").alias("unit")))  # read for the updates and for the columns they change
    updates = fields.filter(F.col("column") == "o_totalprice").select(
        "table", "column", F.lit("money").alias("value"))
    wanted = I.table(spark, sf, "lineitem").select(
        F.expr("'order_' || CAST(l_orderkey AS STRING) || '.maml'").alias("table"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'o_totalprice' WHEN l_returnflag = 'A' "
               "THEN 'o_orderkey' ELSE 'absent' END").alias("column")).distinct()
    return D.get_fields(D.set_fields(fields, updates, "unit"), wanted, "unit")


# --- lint --------------------------------------------------------------------

def lint_sql(table: str, key: str, column: str) -> str:
    """First offending line per text, position by position."""
    def odd(prefix, quote):
        return (f"(length(replace({prefix}, '\\' || {quote}, '')) - "
                f"length(replace(replace({prefix}, '\\' || {quote}, ''), {quote}, ''))) % 2 = 1")
    return f"""SELECT {key}, 'yaml_colon_lint' AS "check", {FAIL} AS severity,
        'no space after colon on line ' || min(n) AS message FROM (
        SELECT {key}, n, line, unnest(list_filter(generate_series(1, len(chars)), lambda i:
                chars[i] = ':' AND i < len(chars) AND chars[i + 1] NOT IN (' ', chr(9)))) AS i
        FROM (SELECT {key}, n, line, string_split(line, '') AS chars FROM (
            SELECT {key}, n, lines[n] AS line FROM (
                SELECT {key}, string_split({column}, chr(10)) AS lines FROM {table}),
                unnest(generate_series(1, len(lines))) AS g(n))
        WHERE regexp_matches(line, ':[^ \\t]') AND NOT regexp_matches(line, '^\\s*(#|$)')))
    WHERE NOT {odd("line[1:i]", "'\"'")} AND NOT {odd("line[1:i]", "''''")}
      AND NOT regexp_matches(line[1:i + 2], '(http|https|ftp)://$')
      AND NOT (regexp_matches(line[1:i - 1], '[0-9]$') AND regexp_matches(line[i + 1], '[0-9]'))
      AND NOT ends_with(line[1:i - 1], 'ivoa')
    GROUP BY {key}"""


@query("yaml_colon_lint", f"""SELECT 'doc_' || CAST(doc_id AS STRING) AS file, * EXCLUDE (doc_id) FROM (
        {lint_sql('documents', 'doc_id', 'text')})
    UNION ALL SELECT 'page_' || CAST(page_id AS STRING), * EXCLUDE (page_id) FROM (
        {lint_sql('pages', 'page_id', 'html')})""")
def yaml_colon_lint(spark, sf):
    texts_ = I.table(spark, sf, "documents").select(
        F.expr("'doc_' || CAST(doc_id AS STRING)").alias("file"), "text").unionByName(
        I.table(spark, sf, "pages").select(
            F.expr("'page_' || CAST(page_id AS STRING)").alias("file"), F.col("html").alias("text")))
    return lint_findings(texts_, ["file"], "text")


