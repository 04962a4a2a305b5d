"""Value checks, profiles and catalogs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegate.operators import catalog, profile, reconcile, values
from tablegate.operators.values import RangeRule, RootRule
from workload import inputs as I
from workload.registry import query

RANGES = {
    "range_left": ("lineitem", RangeRule("l_quantity", 1, 50, "left")),
    "range_right": ("lineitem", RangeRule("l_discount", 0, 0.1, "right")),
    "range_both": ("orders", RangeRule("o_totalprice", 1000, 400000, "both")),
    "range_none": ("events", RangeRule("value", 0, 300, "none")),
}


def predicate(rule: RangeRule) -> str:
    low = ">=" if rule.closed in ("left", "both") else ">"
    high = "<=" if rule.closed in ("right", "both") else "<"
    return f"{rule.column} {low} {rule.lo} AND {rule.column} {high} {rule.hi}"


def range_sql(table: str, rules: list[RangeRule]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{r.column}' AS \"column\", '{r.text}' AS interval, "
        f"coalesce(bool_and({predicate(r)}), TRUE) AS in_range, "
        f"count(*) FILTER (WHERE NOT ({predicate(r)})) AS violations FROM {table}" for r in rules)


for _name, (_table, _rule) in RANGES.items():
    def _range(spark, sf, table=_table, rule=_rule):
        return values.range_check(I.table(spark, sf, table), [rule])
    query(_name, range_sql(_table, [_rule]))(_range)

LINE_RULES = [RangeRule("l_quantity", 1, 50, "left"), RangeRule("l_discount", 0, 0.1, "both"),
              RangeRule("l_tax", 0, 0.08, "right"), RangeRule("l_extendedprice", 0, 100000, "none"),
              RangeRule("l_linenumber", 1, 7), RangeRule("l_orderkey", 0, 10000000000)]


@query("range_check", range_sql("lineitem", LINE_RULES))
def range_check(spark, sf):
    return values.range_check(I.table(spark, sf, "lineitem"), LINE_RULES)


LINE_CATALOG_SQL = """line_catalog AS (
    SELECT 'doc_' || CAST(doc_id AS STRING) AS "table", i - 1 AS pos,
           replace(lines[i], ' ', '_') AS "column"
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
         unnest(generate_series(1, len(lines))) AS g(i))"""


def line_catalog(spark, sf):
    """A catalog with every line of every document as a column name."""
    lines = I.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(F.expr("'doc_' || CAST(doc_id AS STRING)").alias("table"), "pos",
                        F.replace("line", F.lit(" "), F.lit("_")).alias("column"))


@query("find_column", f"""WITH {LINE_CATALOG_SQL}
SELECT "table", arg_min("column", pos) AS "column" FROM line_catalog
WHERE list_contains(string_split("column", '_'), 'the') GROUP BY 1""")
def find_column(spark, sf):
    return catalog.find_columns(line_catalog(spark, sf), "the")


def rule_sql(check, table, column, rule):
    return (f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{check}' AS \"check\", "
            f"CAST(2 AS TINYINT) AS severity, '{column} not in {rule.text}' AS message FROM {table} "
            f"HAVING NOT coalesce(bool_and({predicate(rule)}), TRUE)")


# The given tables hold no sky positions; the same rules run on the columns whose
# names hold these roots.
RA_RULE = RootRule("ra_check", "totalprice", 0, 360000, "left")
DEC_RULE = RootRule("dec_check", "acctbal", -900, 9000, "both")


@query("ra_check", rule_sql("ra_check", "orders", "o_totalprice",
                            RangeRule("o_totalprice", 0, 360000, "left")))
def ra_check(spark, sf):
    return values.coordinate_findings(I.table(spark, sf, "orders"), "orders", [RA_RULE])


@query("dec_check", rule_sql("dec_check", "customer", "c_acctbal",
                             RangeRule("c_acctbal", -900, 9000, "both")))
def dec_check(spark, sf):
    return values.coordinate_findings(I.table(spark, sf, "customer"), "customer", [DEC_RULE])


FAULTY_LINE = {
    "l_tax": "CASE WHEN l_orderkey % 97 = 0 THEN -999 ELSE l_tax END",
    "l_linenumber": "CASE WHEN l_partkey % 89 = 0 THEN -999 ELSE l_linenumber END",
    "l_linestatus": "CASE WHEN l_suppkey % 83 = 0 THEN '-999' ELSE l_linestatus END",
}
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def faulty_lines(spark, sf):
    df = I.table(spark, sf, "lineitem")
    return df.select(*[F.expr(FAULTY_LINE.get(c, c)).cast(df.schema[c].dataType).alias(c)
                       for c in df.columns])


@query("sentinel_scan", " UNION ALL ".join(
    f"SELECT 'lineitem' AS \"table\", '{c}' AS \"column\", coalesce(bool_or({FAULTY_LINE.get(c, c)} = "
    + ("'-999'" if c in ("l_returnflag", "l_linestatus") else "-999")
    + "), FALSE) AS has_sentinel FROM lineitem" for c in LINE_COLUMNS))
def sentinel_scan(spark, sf):
    return values.sentinel_scan(faulty_lines(spark, sf), "lineitem")


@query("any_agg", """SELECT l_returnflag, coalesce(bool_or(l_tax = 0), FALSE) AS any_untaxed,
    coalesce(bool_or(CASE WHEN l_discount > 0.05 THEN l_quantity > 49 END), FALSE) AS any_large
    FROM lineitem GROUP BY 1""")
def any_agg(spark, sf):
    large = F.when(F.col("l_discount") > 0.05, F.col("l_quantity") > 49)
    return I.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        values.any_agg(F.col("l_tax") == 0).alias("any_untaxed"), values.any_agg(large).alias("any_large"))


@query("all_agg", """SELECT l_suppkey, coalesce(bool_and(l_tax > 0), TRUE) AS all_taxed,
    coalesce(bool_and(CASE WHEN l_discount > 0.09 THEN l_quantity > 2 END), TRUE) AS all_large
    FROM lineitem GROUP BY 1""")
def all_agg(spark, sf):
    large = F.when(F.col("l_discount") > 0.09, F.col("l_quantity") > 2)
    return I.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        values.all_agg(F.col("l_tax") > 0).alias("all_taxed"), values.all_agg(large).alias("all_large"))


# --- profiles ----------------------------------------------------------------

PROFILED = {
    "orders": {"o_orderkey": 0, "o_custkey": 1, "o_totalprice": 3},
    "lineitem": {"l_orderkey": 0, "l_partkey": 1, "l_suppkey": 2, "l_linenumber": 3,
                 "l_quantity": 4, "l_extendedprice": 5, "l_discount": 6, "l_tax": 7},
    "events": {"event_id": 0, "user_id": 2, "value": 4},
    "documents": {"doc_id": 0, "n_chars": 4},
}
NAN_VALUE = "CASE WHEN event_id % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


@query("profile_minmax", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {pos} AS pos, '{c}' AS \"column\", CAST(min({v}) AS DOUBLE) + 0.0::DOUBLE AS lo, "
    f"CAST(coalesce(max({v}) FILTER (WHERE NOT isnan(CAST({v} AS DOUBLE))), max({v})) AS DOUBLE) + 0.0::DOUBLE AS hi FROM {t}"
    for t, columns in PROFILED.items() for c, pos in columns.items()
    for v in [NAN_VALUE if c == "value" else c]))
def profile_minmax(spark, sf):
    tables = {name: I.table(spark, sf, name) for name in PROFILED}
    tables["events"] = tables["events"].withColumn("value", F.expr(NAN_VALUE))
    found = profile.profile_minmax(profile.profile_tables(tables))
    return found.select("table", "pos", "column", F.col("min_value").cast("double").alias("lo"),
                        F.col("max_value").cast("double").alias("hi"))


def table_catalog(spark, sf):
    """Columns of every given table with their fill, so the catalog follows the data."""
    return profile.profile_tables({t: I.table(spark, sf, t) for t in I.TABLES})


DTYPES = {
    "region": "r_regionkey int32, r_name string",
    "nation": "n_nationkey int32, n_name string, n_regionkey int32",
    "customer": "c_custkey int64, c_name string, c_nationkey int32, c_acctbal float64, c_mktsegment string",
    "supplier": "s_suppkey int64, s_name string, s_nationkey int32, s_acctbal float64",
    "part": "p_partkey int64, p_name string, p_brand string, p_type string, p_size int32, "
            "p_retailprice float64",
    "orders": "o_orderkey int64, o_custkey int64, o_orderstatus string, o_totalprice float64, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey int64, l_partkey int64, l_suppkey int64, l_linenumber int32, "
                "l_quantity float64, l_extendedprice float64, l_discount float64, l_tax float64, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id int64, ts timestamp_ntz, user_id int64, event_type string, value float64, "
              "props string",
    "documents": "doc_id int64, text string, lang string, source string, n_chars int64",
    "embeddings": "vec_id int64, embedding array<float>, label int32",
    "pages": "page_id int64, url string, html string",
    "benchmark": "item_id int64, text string",
    "labels": "doc_id int64, quality int32, toxic int32",
    "conversations": "conv_id int64, turn int64, role string, text string",
}
CATALOG = [(t, pos, *column.split()) for t, columns in DTYPES.items()
           for pos, column in enumerate(columns.split(", "))]


@query("src_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {pos} AS pos, '{c}' AS \"column\", '{d}' AS dtype, "
    f"count(*) AS n_rows, count(*) - count({c}) AS n_null FROM {t}" for t, pos, c, d in CATALOG))
def src_catalog(spark, sf):
    return table_catalog(spark, sf).select("table", "pos", "column", "dtype", "n_rows", "n_null")


@query("type_support_check", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", 'type_support_check' AS \"check\", "
    f"CAST(2 AS TINYINT) AS severity, 'unsupported type {d}' AS message, count({c}) AS n_values FROM {t}"
    for t, _, c, d in CATALOG if d not in (
        "int16", "int32", "int64", "float32", "float64", "boolean", "string")))
def type_support_check(spark, sf):
    columns = table_catalog(spark, sf)
    filled = columns.select("table", "column", (F.col("n_rows") - F.col("n_null")).alias("n_values"))
    return catalog.type_support_check(columns).join(filled, ["table", "column"])


@query("src_parquet", " UNION ALL ".join(
    [f"SELECT '{t}' AS \"table\", 'scan' AS \"check\", CAST(count(*) AS STRING) || ' rows' AS message FROM {t}"
     for t in I.TABLES] + ["SELECT 'absent', 'src_parquet', 'file not found'"]))
def src_parquet(spark, sf):
    from functools import reduce

    from tablegate.sources import tables as T

    found, absent = T.read_tables(spark, {t: f"{sf}/{t}.parquet" for t in (*I.TABLES, "absent")})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("table"), F.lit("scan").alias("check"),
        F.expr("CAST(n AS STRING) || ' rows'").alias("message")) for name, df in found.items()]
    parts += [T.missing_table(spark, name).select("table", "check", "message") for name in absent]
    return reduce(lambda a, b: a.unionByName(b), parts)


QUANTITY_RULE = RangeRule("l_quantity", 0, 40, "left")


@query("validate_table", " UNION ALL ".join(
    ["SELECT \"table\", \"column\", 'sentinel_scan' AS \"check\", CAST(2 AS TINYINT) AS severity, "
     "'holds the missing-value sentinel' AS message FROM (" + " UNION ALL ".join(
         f"SELECT 'lineitem' AS \"table\", '{c}' AS \"column\" FROM lineitem HAVING bool_or({v} = "
         + ("'-999'" if c == "l_linestatus" else "-999") + ")" for c, v in FAULTY_LINE.items()) + ")",
     rule_sql("ra_check", "lineitem", "l_quantity", QUANTITY_RULE),
     "SELECT 'lineitem', '', 'name_snake_case', CAST(2 AS TINYINT), 'is not lower case' "
     "FROM lineitem HAVING count(*) > 0"]))
def validate_table(spark, sf):
    rules = [RootRule("ra_check", "quantity", 0, 40, "left"), RootRule("dec_check", "discount", 0, 1, "both")]
    return values.validate_table(faulty_lines(spark, sf), "lineitem", "Line_items.parquet", rules)


# --- set operations and order ------------------------------------------------

def event_values(spark, sf):
    return I.table(spark, sf, "events").select(F.col("user_id").alias("key"))


def customer_keys(spark, sf):
    return I.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))


EVENT_KEYS, ORDER_KEYS = "SELECT user_id AS key FROM events", "SELECT o_custkey AS key FROM orders"


@query("set_union", f"{EVENT_KEYS} UNION {ORDER_KEYS}")
def set_union(spark, sf):
    return reconcile.set_union(event_values(spark, sf), customer_keys(spark, sf))


@query("set_difference", f"{ORDER_KEYS} EXCEPT {EVENT_KEYS}")
def set_difference(spark, sf):
    return reconcile.set_difference(customer_keys(spark, sf), event_values(spark, sf))


@query("set_intersection", f"{EVENT_KEYS} INTERSECT {ORDER_KEYS}")
def set_intersection(spark, sf):
    return reconcile.set_intersection(event_values(spark, sf), customer_keys(spark, sf))


@query("first_match", """SELECT user_id, arg_min(event_type, event_id) AS event_type
    FROM events WHERE value > 20 GROUP BY 1""")
def first_match(spark, sf):
    events = I.table(spark, sf, "events").filter("value > 20")
    return catalog.first_match(events, ["user_id"], "event_type", "event_id")


@query("ordered_distinct", """SELECT conv_id, turn, array_to_string(list_transform(
        list_sort(list_transform(list_distinct(w), lambda x: [list_position(w, x)])), lambda p: w[p[1]]), ' ') AS words
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)""")
def ordered_distinct(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat_ws(" ", F.array_distinct(F.split("text", " "))).alias("words"))


@query("sorted_lists", """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(
        string_split(text, ' '))), ' ') AS words FROM conversations""")
def sorted_lists(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat_ws(" ", F.array_sort(F.array_distinct(F.split("text", " ")))).alias("words"))
