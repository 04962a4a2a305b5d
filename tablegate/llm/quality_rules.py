"""Line-first cleaning: judge every line, drop the failures, reject what loses too much.

Native: DataFrame functions only, one narrow projection, no shuffle.

Each ``\\n``-separated line with a word is held against three rules:

* punctuation: eight words or more without closing punctuation at the end, or more than
  three ``!``/``?`` for ten words (three of them at least);
* navigation: three separators ``| > » • ›`` or more, one or more for five words, or more
  than a tenth of its visible characters are ``#*$%&|<>``;
* boilerplate: a phrase of site furniture (cookie and script notices, log-in prompts...).

Failing lines go.  A document that so loses more than half of its word characters is
rejected, and so is one that fails the base measures.

Defined cases: a null or empty text has no words, all counts are 0 and it fails the base;
repeated rows give repeated results; an empty table gives an empty result; extra columns
are ignored.  The 8-word windows of one text are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import SPACE, SPACES, let, whole

# Fixed values of the measures.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»•›"
MARKS = SYMBOLS + "»•›!?"
WINDOW = 8
MIN_WORDS = 20
CLOSED = r"""[.!?…:;。！？]["'»”’)\]]*$"""
FURNITURE = (
    "cookie|javascript|all rights reserved|terms of use|terms of service|privacy policy|"
    "click here|sign in|log in|subscribe|read more|skip to content|back to top|lorem ipsum")


def _holds(text: Column, parts) -> Column:
    """Whether a text holds any of these: byte searches, far cheaper than a pattern."""
    return reduce(Column.__or__, [text.contains(x) for x in parts])


def words_of(line: Column) -> Column:
    pieces = F.when(_holds(line, SPACES.replace(" ", "")), F.split(line, SPACE + "+", -1)).otherwise(
        F.split(line, " ", -1))
    return F.filter(pieces, lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort, compare neighbours, and
    add up the steps between the starts."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twins = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    return let(let(pairs, starts), lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


def repeated_words(words: Column) -> Column:
    """Hashes of 8 words from those of 1, 2 and 4 at each place, then the repeated ones."""
    def doubled(hashes: Column, by: int) -> Column:
        return let(hashes, lambda h: F.zip_with(
            h, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    hashes = doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    windows = let(hashes, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h))
               .otherwise(F.lit(0).cast("long")))


def _line(line: Column) -> Column:
    """A line's words, their code points, and the marks among its characters."""
    return let(words_of(line), lambda w: F.struct(
        line.alias("line"), w.alias("words"), F.length(F.array_join(w, "")).alias("n"),
        F.when(_holds(line, MARKS), F.regexp_replace(line, f"[^{MARKS}]+", "")).otherwise("").alias("marks")))


def _within(line: Column, characters: str) -> Column:
    """How many of these characters a line holds (its marks are a short text)."""
    return F.length(line["marks"]) - F.length(F.translate(line["marks"], characters, ""))


def line_fails(line: Column) -> Column:
    words, text = F.size(line["words"]), F.lower(line["line"])
    marks, separators = _within(line, "!?"), _within(line, SEPARATORS)
    punctuation = ((words >= 8) & ~F.get(line["words"], words - 1).rlike(CLOSED)) | ((marks >= 3) & (marks * 10 > words * 3))
    navigation = ((separators >= 3) & (separators * 5 >= words)) | (_within(line, SYMBOLS) * 10 > line["n"])
    furniture = let(text, lambda t: _holds(t, FURNITURE.split("|")))
    return punctuation | navigation | furniture


def _total(lines: Column, value) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + value(x))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row: the base measures, ``n_lines``, ``n_failed_lines``, ``lost_chars``,
    ``clean_text`` and the verdicts ``base_failed`` and ``kept``."""
    lines = F.transform(F.split(whole(), "\n", -1), _line)
    judged = F.transform(lines, lambda x: F.struct(
        x["line"].alias("line"), x["words"].alias("words"), x["n"].alias("n"),
        _within(x, SYMBOLS).alias("symbols"), ((x["n"] > 0) & line_fails(x)).alias("fails")))

    def measures(x: Column) -> Column:
        filled = F.transform(F.filter(x, lambda y: y["n"] > 0), lambda y: y["line"])
        return F.struct(
            _total(x, lambda y: F.size(y["words"])).alias("n_words"),
            _total(x, lambda y: y["n"]).alias("word_chars"),
            _total(x, lambda y: y["symbols"]).alias("n_symbols"),
            let(filled, lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
            repeated_words(F.flatten(F.transform(x, lambda y: y["words"]))).alias("n_repeat_words"),
            _total(x, lambda y: (y["n"] > 0).cast("long")).alias("n_lines"),
            _total(x, lambda y: y["fails"].cast("long")).alias("n_failed_lines"),
            _total(x, lambda y: F.when(y["fails"], y["n"]).otherwise(0)).alias("lost_chars"),
            F.array_join(F.transform(F.filter(x, lambda y: ~y["fails"]), lambda y: y["line"]), "\n")
            .alias("clean_text"))

    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (docs.select("doc_id", F.array(let(judged, measures)).alias("m"))
            .select("doc_id", F.inline_outer("m"))  # evaluated once, then opened
            .withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 2 <= F.col("word_chars"))))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        string_split(text, chr(10)) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(8) AS r(k) GROUP BY doc_id),
l AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
        length(regexp_replace(line, '[^!?]', '', 'g')) AS marks,
        length(regexp_replace(line, '[^|>»•›]', '', 'g')) AS seps,
        length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms
      FROM (SELECT doc_id, unnest(lines) AS line FROM w)),
j AS (SELECT doc_id, line, n, n > 0 AND (
        (words >= 8 AND NOT regexp_matches(line, '[.!?…:;。！？]["''»”’)\]]*[\x20\x09-\x0D]*$'))
        OR (marks >= 3 AND marks * 10 > words * 3)
        OR (seps >= 3 AND seps * 5 >= words) OR syms * 10 > n
        OR regexp_matches(lower(line), 'FURNITURE')) AS fails FROM l),
a AS (SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (fails) AS n_failed_lines,
        coalesce(sum(n) FILTER (fails), 0)::BIGINT AS lost_chars,
        count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines
      FROM j GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, a.n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, a.n_lines, a.n_failed_lines, a.lost_chars
      FROM w JOIN a USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= word_chars AS kept
FROM m
""".replace("FURNITURE", FURNITURE)
