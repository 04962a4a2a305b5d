"""Name rules over every candidate name of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate.functions.findings import all_of, explode_findings
from tablegate.functions.text import fuzzy_ratio
from tablegate.operators import names as N
from tablegate.rules import DEFAULT_RULES
from tablegate.sources import vocabulary as V
from workload import inputs as I
from workload.registry import query

FAIL, WARN = "CAST(2 AS TINYINT)", "CAST(1 AS TINYINT)"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(
        literal(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


FILTERS = f"filters(pos, name, inverse) AS ({values((i, f.name, f.inverse) for i, f in enumerate(DEFAULT_RULES.filters))})"
BANNED = f"banned(word) AS ({values((w,) for w in DEFAULT_RULES.banned)})"
MISTAKES = "mistakes(mistake, canonical) AS (" + values(
    (m, w.name) for w in DEFAULT_RULES.protected for m in w.mistakes) + ")"
EXCEPTIONS = f"exceptions(name) AS ({values((w.name,) for w in DEFAULT_RULES.exceptions)})"


def squash(column: str) -> str:
    return f"lower(replace({column}, '_', ''))"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by the full table: rows over ``a``, cells over ``b``."""
    matches = (f"list_transform(string_split({a}, ''), lambda c: "
               f"list_transform(string_split({b}, ''), lambda d: CASE WHEN c = d THEN 1 ELSE 0 END))")
    cells = (f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INTEGER)]), "
             "lambda acc, j: list_append(acc, CASE WHEN m[j[1]] = 1 THEN row[j[1]] + 1 "
             "ELSE greatest(row[j[1] + 1], acc[-1]) END), [0])")
    zeros = f"list_transform(range(0, length({b}) + 1), lambda j: 0)"
    return f"(list_reduce({matches}, lambda row, m: {cells}, {zeros}))[-1]"


def ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return (f"CAST(round_even((1.0::DOUBLE - ({total} - 2 * {lcs(a, b)})::DOUBLE / {total}) * 100, 0) AS INTEGER)")


def near(a: str, b: str, above: int) -> str:
    """Pairs worth the full table.  The edit distance counts bytes, so names beyond
    ASCII always are."""
    return (f"(length({a}) <> strlen({a}) OR levenshtein({a}, {b}) <= "
            f"(length({a}) + length({b})) * {(100 - above) / 100} + 1) "
            f"AND 200 * least(length({a}), length({b})) >= {above} * (length({a}) + length({b}))")


# Every rule as SQL: findings (name, check, severity, message) over the names CTE.
RULE_SQL = {
    "name_length": f"""
        SELECT name, 'name_length' AS "check", {FAIL} AS severity,
               'too long: ' || length(name) || ' of 50' AS message FROM names WHERE length(name) > 50
        UNION ALL SELECT name, 'name_length', {WARN}, 'long: ' || length(name) || ' of 50'
        FROM names WHERE length(name) BETWEEN 31 AND 50""",
    "name_no_decimals": f"""
        SELECT name, 'name_no_decimals' AS "check", {FAIL} AS severity, 'contains a decimal point' AS message
        FROM names WHERE contains(name, '.')""",
    "name_alpha_start": f"""
        SELECT name, 'name_alpha_start' AS "check", {FAIL} AS severity,
               'does not start with a letter' AS message
        FROM names WHERE NOT regexp_matches(name, '^\\p{{L}}')""",
    "name_snake_case": f"""
        SELECT name, 'name_snake_case' AS "check", {FAIL} AS severity, message FROM (
            SELECT name, unnest([
                CASE WHEN name LIKE '%\\_' ESCAPE '\\' THEN 'ends with an underscore' END,
                CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'starts with an underscore' END,
                CASE WHEN contains(name, '__') THEN 'has repeated underscores' END,
                CASE WHEN rest <> '' AND NOT (regexp_matches(rest, '\\p{{Ll}}')
                     AND NOT regexp_matches(rest, '[\\p{{Lu}}\\p{{Lt}}]')) THEN 'is not lower case' END,
                CASE WHEN NOT regexp_matches(replace(name, '_', ''), '^[\\p{{L}}\\p{{N}}]+$')
                     THEN 'has other than letters and digits' END]) AS message
            FROM (SELECT name, {{rest}} AS rest FROM names)) WHERE message IS NOT NULL""",
    "name_banned": f"""
        SELECT name, 'name_banned' AS "check", {FAIL} AS severity, 'contains banned word ' || word AS message
        FROM names, banned WHERE contains(name, word)
        UNION ALL
        SELECT name, 'name_banned', s.severity, s.message FROM (
            SELECT name, word, CASE WHEN {near('token', 'word', 80)} THEN {ratio('token', 'word')} END AS r
            FROM (SELECT name, unnest(string_split(lower(name), '_')) AS token FROM names), banned),
            (VALUES (85, {FAIL}, 'resembles banned word '), (80, {WARN}, 'may be banned word '))
            AS l(above, severity, prefix), LATERAL (SELECT l.severity, l.prefix || word AS message) s
        WHERE r > above""",
    "name_protected": f"""
        SELECT name, 'name_protected' AS "check", {FAIL} AS severity, 'use ' || canonical AS message
        FROM names, mistakes WHERE name = mistake
        UNION ALL SELECT name, 'name_protected', {WARN}, 'did you mean ' || canonical
        FROM (SELECT name, unnest(string_split(name, '_')) AS token FROM names), mistakes
        WHERE lower(token) = lower(mistake)""",
    "name_exception_case": f"""
        SELECT n.name, 'name_exception_case' AS "check", {FAIL} AS severity,
               'wrong case of ' || e.name AS message FROM names n, exceptions e
        WHERE contains(lower(replace(n.name, '_', '')), lower(e.name))
          AND NOT contains(replace(n.name, '_', ''), e.name)""",
    "name_filter_inverse": f"""
        SELECT n.name, 'name_filter_inverse' AS "check", {FAIL} AS severity,
               'reversed, use ' || f.name AS message FROM names n, filters f
        WHERE contains({squash('n.name')}, {squash('f.inverse')})""",
    "name_filter_case": f"""
        SELECT n.name, 'name_filter_case' AS "check", {FAIL} AS severity,
               'misspelt, use ' || f.name AS message FROM names n, filters f
        WHERE contains({squash('n.name')}, {squash('f.name')}) AND NOT contains(n.name, f.name)""",
    "name_filter_fuzzy": f"""
        SELECT name, 'name_filter_fuzzy' AS "check", l.severity, l.prefix || filter AS message FROM (
            SELECT name, filter, greatest(
                CASE WHEN {near('plain', 'word', 70)} THEN {ratio('plain', 'word')} ELSE 0 END,
                CASE WHEN {near('plain', 'inverse', 70)} THEN {ratio('plain', 'inverse')} ELSE 0 END) AS r
            FROM (SELECT n.name, f.name AS filter, {squash('n.name')} AS plain, {squash('f.name')} AS word,
                         {squash('f.inverse')} AS inverse FROM names n, filters f)),
            (VALUES (80, {FAIL}, 'resembles '), (70, {WARN}, 'did you mean ')) AS l(above, severity, prefix)
        WHERE r > above""",
}


def _rest(column: str) -> str:
    for word in (*DEFAULT_RULES.filters, *DEFAULT_RULES.exceptions):
        column = f"replace({column}, {literal(word.name)}, '')"
    return column


RULE_SQL["name_snake_case"] = RULE_SQL["name_snake_case"].replace("{rest}", _rest("name"))
RULE_TABLES = f"{FILTERS}, {BANNED}, {MISTAKES}, {EXCEPTIONS}"

CHECKS = {
    "name_length": N.name_length,
    "name_no_decimals": N.name_no_decimals,
    "name_alpha_start": N.name_alpha_start,
    "name_snake_case": N.name_snake_case,
    "name_banned": N.name_banned,
    "name_protected": N.name_protected,
    "name_exception_case": N.name_exception_case,
    "name_filter_inverse": N.name_filter_inverse,
    "name_filter_case": N.name_filter_case,
    "name_filter_fuzzy": N.name_filter_fuzzy,
}

for _name, _check in CHECKS.items():
    def _run(spark, sf, check=_check):
        return explode_findings(I.candidate_names(spark, sf), ["name"], check(F.col("name")))
    query(_name, f"WITH {I.NAMES_SQL}, {RULE_TABLES} {RULE_SQL[_name]}")(_run)


@query("validate_column_names", f"WITH {I.NAMES_SQL}, {RULE_TABLES} "
       + " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in RULE_SQL.values()))
def validate_column_names(spark, sf):
    return N.validate_column_names(I.candidate_names(spark, sf))


@query("rule_join", f"WITH {I.NAMES_SQL}, {RULE_TABLES} " + " UNION ALL ".join(
    f"SELECT * FROM ({RULE_SQL[c]})" for c in ("name_filter_inverse", "name_filter_case", "name_protected")))
def rule_join(spark, sf):
    """Names against rules by containment and equality, without a join operator."""
    name = F.col("name")
    return explode_findings(
        I.candidate_names(spark, sf), ["name"],
        all_of(N.name_filter_inverse(name), N.name_filter_case(name), N.name_protected(name)))


FILE_NAMES_SQL = f"""{I.PART_NAMES_SQL}, stems AS (
    SELECT name || '.parquet' AS file, name FROM part_names
    UNION SELECT c_name || '.v2.parquet', c_name || '.v2' FROM customer), names AS MATERIALIZED (SELECT DISTINCT name FROM stems)"""


@query("validate_table_names", f"WITH {FILE_NAMES_SQL}, {RULE_TABLES} SELECT file, f.* EXCLUDE (name) FROM ("
       + " UNION ALL ".join(f"SELECT * FROM ({RULE_SQL[c]})" for c in (
           "name_alpha_start", "name_snake_case", "name_no_decimals", "name_exception_case",
           "name_protected")) + ") f JOIN stems USING (name)")
def validate_table_names(spark, sf):
    files = I.part_names(spark, sf).select(F.expr("name || '.parquet'").alias("file")).unionByName(
        I.table(spark, sf, "customer").select(F.expr("c_name || '.v2.parquet'").alias("file")))
    return N.validate_table_names(files)


@query("fuzzy_ratio", f"SELECT p_partkey, {ratio('p_name', 'p_type')} AS ratio, "
       f"{ratio('p_brand', 'p_name')} AS brand_ratio FROM (SELECT p_partkey, p_name, lower(p_type) AS p_type, "
       "p_brand FROM part)")
def fuzzy_ratio_query(spark, sf):
    # Long work on short rows: dealt out by key, whatever the files.
    part = I.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand").repartition("p_partkey")
    return part.select(
        "p_partkey", fuzzy_ratio(F.col("p_name"), F.lower("p_type")).alias("ratio"),
        fuzzy_ratio(F.col("p_brand"), F.col("p_name")).alias("brand_ratio"))


@query("src_rules", f"""WITH {I.PART_NAMES_SQL}
    SELECT name, array_to_string(list_reverse(string_split(name, '_')), '_') AS inverse_name FROM part_names""")
def src_rules(spark, sf):
    return V.filter_rules(I.part_names(spark, sf))
