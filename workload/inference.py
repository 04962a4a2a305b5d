"""Units, tags, repairs and skeletons inferred for the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablegate.operators import infer, profile, tags
from tablegate.rules import DEFAULT_RULES
from tablegate.sources import sinks
from tablegate.sources.vocabulary import vocabulary
from workload import inputs as I
from workload.names import literal, values
from workload.registry import query

# Vocabulary words by the parts that would carry them.
WORDS = (
    ("meta.id", "Q"), ("meta.main", "S"), ("pos.eq.ra", "Q"), ("pos.eq.dec", "P"), ("phot.mag", "E"),
    ("phys.magAbs", "P"), ("stat.error", "P"), ("phot.flux.density", "E"), ("phot.flux", "E"),
    ("phys.mass", "Q"), ("em.opt.U", "S"), ("em.opt.R", "S"), ("em.IR", "S"), ("em.IR.3-4um", "S"),
    ("em.IR.K", "S"), ("em.IR.4-8um", "S"), ("instr.param", "Q"), ("instr.pixel", "S"),
    ("pos.posAng", "Q"), ("phys.veloc", "S"))
VOCAB_NAME = I.choose(f"p_partkey % {len(WORDS)}", I.quoted(*[w for w, _ in WORDS]))
VOCAB_TYPE = I.choose(f"p_partkey % {len(WORDS)}", I.quoted(*[t for _, t in WORDS]))
VOCAB_SQL = f"""vocab AS MATERIALIZED (SELECT DISTINCT lower({VOCAB_NAME}) AS name,
    {VOCAB_TYPE} IN ('Q', 'P', 'E', 'V', 'C') AS is_primary,
    {VOCAB_TYPE} IN ('Q', 'S', 'E', 'V', 'C') AS is_secondary FROM part)"""


def rule_vocabulary(spark, sf):
    return vocabulary(I.table(spark, sf, "part").select(
        F.expr(VOCAB_TYPE).alias("type"), F.expr(VOCAB_NAME).alias("name"),
        F.lit("").alias("descr")).distinct())


UNITS = "units(pos, name, unit) AS (" + values(
    (i, w.name, w.units[0]) for i, w in enumerate(DEFAULT_RULES.protected)) + ")"
UNIT_SQL = f"""coalesce((SELECT arg_min(unit, pos) FROM units u WHERE CASE WHEN contains(u.name, '_')
    THEN contains(n.name, u.name) ELSE list_contains(string_split(n.name, '_'), u.name) END), '--')"""


@query("guess_unit", f"WITH {I.NAMES_SQL}, {UNITS} SELECT n.name, {UNIT_SQL} AS unit FROM names n")
def guess_unit(spark, sf):
    return I.candidate_names(spark, sf).select("name", infer.guess_unit(F.col("name")).alias("unit"))


TAG_RULES = "tag_rules(grp, pos, name, wide, tag) AS (" + values(
    [(0, i, w.name, True, w.tag) for i, w in enumerate(DEFAULT_RULES.exceptions)]
    + [(1, i, w.name, "_" in w.name, ";".join(w.tags)) for i, w in enumerate(DEFAULT_RULES.protected)]
    + [(2, i, w.name, True, w.tag) for i, w in enumerate(DEFAULT_RULES.filters)]) + ")"


def repaired(source: str, keys: str, output: str, full: bool = False) -> str:
    """Closed form over a ``words`` list of {w, p, s} structs, in steps: the head is the
    first primary word that starts the longest arrangement, secondary words follow."""
    head = "list_filter(heads, lambda h: 1 + len(sec) - CASE WHEN words[h].s THEN 1 ELSE 0 END >= longest)[1]"
    return f"""SELECT {keys}, CASE WHEN len(heads) > 0 AND longest >= 2 THEN array_to_string(list_transform(
            list_prepend(head, list_filter(sec, lambda i: i <> head)[1:longest - 1]),
            lambda i: words[i].w), ';') ELSE '' END AS {output}
        FROM (SELECT *, {head} AS head FROM (
            SELECT *, least(len(words){'' if full else ' - 1'}, list_max(list_transform(heads, lambda h:
                1 + len(sec) - CASE WHEN words[h].s THEN 1 ELSE 0 END))) AS longest FROM (
                SELECT {keys}, words, list_filter(generate_series(1, len(words)), lambda i: words[i].p) AS heads,
                       list_filter(generate_series(1, len(words)), lambda i: words[i].s) AS sec FROM {source})))"""


# A name that holds any of the wide rules' words meets all of them; the other rules are looked up by part.
WIDE = "|".join(re.escape(w.name) for w in (*DEFAULT_RULES.exceptions, *DEFAULT_RULES.filters, *DEFAULT_RULES.protected)
                if w not in DEFAULT_RULES.protected or "_" in w.name)
GUESS_SQL = f"""wide_names AS MATERIALIZED (SELECT name FROM names WHERE regexp_matches(name, {literal(WIDE)})),
    parts AS MATERIALIZED (SELECT DISTINCT name, unnest(string_split(name, '_')) AS part FROM names),
    hits AS MATERIALIZED (
        SELECT n.name, r.grp, r.pos, r.tag FROM wide_names n, (SELECT * FROM tag_rules WHERE wide) r WHERE contains(n.name, r.name)
        UNION ALL SELECT p.name, r.grp, r.pos, r.tag FROM parts p
        JOIN (SELECT * FROM tag_rules WHERE NOT wide) r ON p.part = r.name),
    firsts AS MATERIALIZED (SELECT name, w, min(grp * 1000000 + pos * 1000 + i) AS k, max(grp) AS g FROM (
        SELECT name, grp, pos, i, parts[i] AS w FROM (
            SELECT *, string_split(tag, ';') AS parts FROM hits), unnest(generate_series(1, len(parts))) AS t(i))
        GROUP BY 1, 2),
    banded AS (SELECT DISTINCT name FROM hits WHERE grp = 2),
    listed AS MATERIALIZED (SELECT name, list(w ORDER BY k) AS ws FROM firsts GROUP BY 1),
    prefixed AS (SELECT name, CASE WHEN len(ws) = 1 AND name IN (SELECT name FROM banded)
        AND NOT contains(ws[1], 'phot.mag') THEN list_prepend('phot.mag', ws) ELSE ws END AS ws FROM listed),
    judged AS MATERIALIZED (SELECT x.name, list({{'w': w, 'p': coalesce(is_primary, FALSE), 's': coalesce(is_secondary, FALSE)}}
            ORDER BY i) AS words FROM (
        SELECT p.name, i, ws[i] AS w FROM prefixed p, unnest(generate_series(1, len(ws))) AS t(i)) x
        LEFT JOIN vocab v ON lower(x.w) = v.name GROUP BY 1),
    guessed AS MATERIALIZED (SELECT name, CASE WHEN words[1].p AND len(list_filter(words[2:], lambda x: NOT x.s)) = 0
        THEN array_to_string(list_transform(words, lambda x: x.w), ';') ELSE fixed END AS ucd
        FROM judged JOIN ({repaired('judged', 'name', 'fixed')}) USING (name))"""


@query("guess_ucd", f"""WITH {I.NAMES_SQL}, {VOCAB_SQL}, {TAG_RULES}, {GUESS_SQL}
    SELECT n.name, coalesce(g.ucd, '') AS ucd FROM names n LEFT JOIN guessed g ON n.name = g.name""")
def guess_ucd(spark, sf):
    return infer.guess_ucd(I.candidate_names(spark, sf), rule_vocabulary(spark, sf))


LINE_FLAGS = "list_transform(string_split(line, ' '), lambda w: {'w': w, " \
    "'p': length(w) % 4 = 0, 's': length(w) % 3 = 0})"


@query("ucd_repair", f"""WITH flagged AS MATERIALIZED (SELECT doc_id, line_no, {LINE_FLAGS} AS words FROM (
        SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (
            SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
            unnest(generate_series(1, len(lines))) AS g(i)))
    SELECT * FROM ({repaired('flagged', 'doc_id, line_no', 'repaired')})
    JOIN ({repaired('flagged', 'doc_id, line_no', 'rearranged', True)}) USING (doc_id, line_no)""")
def ucd_repair(spark, sf):
    lines = I.table(spark, sf, "documents").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    words = F.transform(F.split("line", " "), lambda w: F.struct(
        w.alias("word"), (F.length(w) % 4 == 0).alias("is_primary"),
        (F.length(w) % 3 == 0).alias("is_secondary")))
    flagged = lines.select("doc_id", "line_no", words.alias("words"))
    return flagged.select(
        "doc_id", "line_no", tags.ucd_repair(F.col("words")).alias("repaired"),
        tags.ucd_repair(F.col("words"), full=True).alias("rearranged"))


# The given columns under names the rules know.
RENAMED = {
    "lineitem": {"l_orderkey": "uberID", "l_quantity": "mag_u_SDSS", "l_extendedprice": "flux_density",
                 "l_discount": "ra", "l_tax": "dec_err", "l_returnflag": "W1_WISE_flag",
                 "l_linenumber": "pos_ang_pix"},
    "customer": {"c_custkey": "uberID", "c_acctbal": "mass_K_VISTA", "c_nationkey": "z_spec"},
}
CASTS = {"l_discount": "float"}


def renamed(spark, sf):
    out = {}
    for name, columns in RENAMED.items():
        df = I.table(spark, sf, name)
        out[name] = df.select(*[
            (F.col(c).cast(CASTS[c]) if c in CASTS else F.col(c)).alias(columns.get(c, c)) for c in df.columns])
    return out


def inferred(spark, sf):
    return infer.infer_fields(profile.profile_tables(renamed(spark, sf)), rule_vocabulary(spark, sf))


def _fields_sql() -> str:
    from workload.values import DTYPES
    rows = []
    for t, columns in RENAMED.items():
        for pos, column in enumerate(DTYPES[t].split(", ")):
            c, d = column.split()
            dtype = "float32" if c in CASTS else d
            numeric = dtype in ("int32", "int64", "float32", "float64")
            value = f"CAST({c} AS FLOAT)" if c in CASTS else c
            bounds = f"CAST(min({value}) AS DOUBLE) + 0.0::DOUBLE, CAST(max({value}) AS DOUBLE) + 0.0::DOUBLE" if numeric else \
                "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
            rows.append(f"SELECT '{t}', {pos}, '{columns.get(c, c)}', '{dtype}', {bounds}, "
                        f"{'FALSE' if d.startswith('timestamp') else 'TRUE'} FROM {t} HAVING count(*) >= 0")
    return f'fields("table", pos, name, data_type, lo, hi, supported) AS MATERIALIZED ({" UNION ALL ".join(rows)}), ' \
        "names AS (SELECT DISTINCT name FROM fields)"


INFERRED_SQL = f"""{_fields_sql()}, {VOCAB_SQL}, {TAG_RULES}, {UNITS}, {GUESS_SQL}, inferred AS MATERIALIZED (
    SELECT "table", pos, n.name, data_type, {UNIT_SQL} AS unit, '--' AS info, coalesce(g.ucd, '') AS ucd,
           lo, hi, supported FROM fields n LEFT JOIN guessed g ON n.name = g.name)"""


@query("infer_fields", f"""WITH {INFERRED_SQL} SELECT "table", pos, name, data_type, unit, info, ucd,
    lo AS qc_min, hi AS qc_max, supported FROM inferred""")
def infer_fields(spark, sf):
    def number(column):
        return F.when(F.col("data_type") == "float32", F.col(column).cast("float").cast("double")
                      ).otherwise(F.col(column).cast("double"))

    return inferred(spark, sf).withColumns({"qc_min": number("qc_min"), "qc_max": number("qc_max")})


DATE = "2024-05-06"
HEAD = ["# Generated skeleton. This comment can be deleted.", "survey:", "dataset:", None, "version:",
        f'date: "{DATE}"', "author:", "description:", 'license: "Copyright WAVES [Private]"',
        "MAML_version: 1.1", "fields:"]
HEAD_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT \"table\", -1 AS pos, {i} AS line_no, "
    + (literal(text) if text is not None else "'table: \"' || \"table\" || '\"'") + " AS line FROM inferred"
    for i, text in enumerate(HEAD))


def _blank(column: str) -> str:
    return f"CASE WHEN {column} IN ('', '--') THEN '' ELSE ' \"' || {column} || '\"' END"


ENTRY = ["'- name: \"' || name || '\"'", f"'  unit:' || {_blank('unit')}", f"'  info:' || {_blank('info')}",
         f"'  ucd:' || {_blank('ucd')}", "'  data_type: ' || data_type"]
SKELETON_SQL = HEAD_SQL + "".join(
    f" UNION ALL SELECT \"table\", pos, {i}, {line} FROM inferred WHERE supported" for i, line in enumerate(ENTRY)) \
    + " UNION ALL SELECT \"table\", pos, 5, '  qc:' FROM inferred WHERE supported AND lo IS NOT NULL" \
    + " UNION ALL SELECT \"table\", pos, 6, '    min: ' || round(lo, 2) FROM inferred WHERE supported AND lo IS NOT NULL" \
    + " UNION ALL SELECT \"table\", pos, 7, '    max: ' || round(hi, 2) FROM inferred WHERE supported AND lo IS NOT NULL"


def comparable(lines):
    """Bounds rounded as numbers: the engines write the same number differently."""
    bound = F.regexp_extract("line", r"^(    m(?:in|ax): )(.*)$", 2).try_cast("double")
    text = F.concat(F.regexp_extract("line", r"^(    m(?:in|ax): )", 1), F.round(bound, 2).cast("decimal(20,2)").cast("string"))
    return lines.withColumn("line", F.when(bound.isNotNull(), text).otherwise(F.col("line")))


SKELETON_SQL = SKELETON_SQL.replace("round(lo, 2)", "CAST(CAST(round(lo, 2) AS DECIMAL(20, 2)) AS VARCHAR)").replace(
    "round(hi, 2)", "CAST(CAST(round(hi, 2) AS DECIMAL(20, 2)) AS VARCHAR)")


@query("generate_skeleton", f"WITH {INFERRED_SQL} SELECT * FROM ({SKELETON_SQL})")
def generate_skeleton(spark, sf):
    return comparable(sinks.skeleton_lines(inferred(spark, sf), DATE))
