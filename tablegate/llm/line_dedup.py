"""Lines that spread over many sites: sketch per line hash, exact counts near the threshold.

Native: DataFrame functions only.

1. Every line with a word (trimmed of white space) is hashed; per hash a HyperLogLog sketch
   of the sites (``source``) is built on the map side and merged by the aggregation.
2. Lines whose estimate is clearly over or under ``min_sites`` are decided.  Those within
   the margin (five standard errors, and one site at least) get an exact distinct count.
3. Lines on ``min_sites`` sites or more are boilerplate: all their occurrences go.

With ``distinct_texts`` rows of one text count with the smallest of their sites only, so that a
whole document copied to many sites keeps its lines (its copies are left to near-copy removal).
Copies can only add sites: the sketches over all rows then tell which lines come into question,
and all of these get an exact count, over one row per line and text.

Lines travel as hashes (64 + 32 bits); texts are joined once with the removed positions.
A hot line is one sketch per map task after the partial aggregation; a hot site is one value.

Defined cases: a null text stays null and has no lines; null sites count for no line; the
order and the spelling of kept lines stay; a text all of whose lines go is the empty text;
repeated rows are cleaned alike; an empty table stays empty; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import SPACES, TAG, let, stored

MIN_SITES = 10
LOG_K = 12
#: Relative standard error of a sketch of 2**LOG_K registers.
ERROR = 1.04 / 2 ** (LOG_K / 2)


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line with a word: document key, place, hashes, site."""
    line = F.btrim("line", F.lit(SPACES))
    return (docs.select("doc_id", TAG, F.col("source").cast("string").alias("site"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .select("doc_id", TAG, "site", "pos", line.alias("line")).where("line != ''")
            .select("doc_id", TAG, "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, distinct_texts: bool = False) -> DataFrame:
    """Hashes of the lines on ``min_sites`` sites or more."""
    margin = max(1.0, 5 * ERROR * min_sites)
    # Few lines are left; stored, so that the joins with them are of plain shuffles, which split.
    sketched = stored(lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
                      .select("h", "g", F.hll_sketch_estimate("sketch").alias("sites"))
                      .where(F.col("sites") >= min_sites - margin))
    if distinct_texts:
        # Stored, so that a hot line's rows are dealt by line and text, not by line as in the join.
        found = stored(lines.join(sketched, ["h", "g"], "left_semi").select("h", "g", TAG, "site"))
        once = found.groupBy("h", "g", TAG).agg(F.min("site").alias("site")).select("h", "g", "site").distinct()
        return stored(once.groupBy("h", "g").agg(F.count("site").alias("sites"))
                      .where(F.col("sites") >= min_sites).select("h", "g"))
    sure = sketched.where(F.col("sites") > min_sites + margin).select("h", "g")
    near = sketched.where(F.col("sites") <= min_sites + margin).select("h", "g")
    exact = (lines.join(near, ["h", "g"], "left_semi").select("h", "g", "site").distinct()
             .groupBy("h", "g").agg(F.count("site").alias("sites"))
             .where(F.col("sites") >= min_sites).select("h", "g"))
    return stored(sure.unionByName(exact))


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines at these places, in linear time."""
    def keep(x: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), removed)
        return F.array_join(F.transform(places, lambda p: F.get(x, p)), "\n")
    return let(F.split(text, "\n", -1), keep)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = False,
               distinct_texts: bool = False) -> DataFrame:
    """The documents, their columns and all rows, with cleaned ``text``.

    ``distinct_texts`` lets exact copies count as one document; ``counts`` adds ``n_lines`` (lines with a word) and ``n_removed``.
    """
    columns = docs.columns
    tagged = docs.withColumn(TAG, F.xxhash64("text"))
    lines = stored(_lines(tagged))  # hashes and places; read three times
    removed = (lines.join(boilerplate(lines, min_sites, distinct_texts), ["h", "g"], "left_semi")
               .groupBy("doc_id", TAG).agg(F.collect_set("pos").alias("removed"))
               .select(F.col("doc_id").alias("__tablegate_id"), F.col(TAG).alias("__tablegate_of"),
                       F.col("removed").alias("__tablegate_removed")))
    joined = tagged.join(removed, tagged["doc_id"].eqNullSafe(removed["__tablegate_id"])
                         & (tagged[TAG] == removed["__tablegate_of"]), "left")
    gone = F.col("__tablegate_removed")
    text = F.when(gone.isNull(), F.col("text")).otherwise(_without(F.col("text"), gone))
    out = [text.alias(c) if c == "text" else F.col(c) for c in columns]
    if counts:
        out += [F.coalesce(F.size(F.filter(F.split("text", "\n", -1),
                                           lambda x: F.btrim(x, F.lit(SPACES)) != "")), F.lit(0))
                .cast("long").alias("n_lines"),
                F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


SQL = r"""
WITH l AS (SELECT doc_id, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
b AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 10),
k AS (SELECT doc_id, count(*) FILTER (l.key <> '') AS n_lines, count(b.key) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.key IS NULL), '') AS kept
      FROM l LEFT JOIN b USING (key) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
