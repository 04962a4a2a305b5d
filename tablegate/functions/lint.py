"""Spacing lint for YAML text: a colon must be followed by a space.

Exempt are colons inside quotes, of ``http://`` / ``https://`` / ``ftp://``, between
two digits, and after a known namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.functions.findings import FAIL, explode_findings, when_found
from tablegate.functions.text import let
from tablegate.rules import NAMESPACES

SUSPECT = r":[^ \t]"


def _quotes(piece: Column, quote: str) -> Column:
    """Number of unescaped quote characters in a piece of a line."""
    return F.size(F.regexp_extract_all(piece, F.lit(rf"(?<!\\){quote}"), F.lit(0)))


def colon_offence(line: Column, namespaces=NAMESPACES) -> Column:
    """1-based column of a line's first offending colon, null when there is none.

    The line is cut at its colons and the pieces are walked once, carrying the quote
    counts and the column, so the work is linear in the line's length.
    """
    def first(pieces):
        def step(state, i):
            piece, rest = F.element_at(pieces, i), F.element_at(pieces, i + 1)
            double = state["double"] + _quotes(piece, '"')
            single = state["single"] + _quotes(piece, "'")
            col = state["col"] + F.length(piece) + 1
            ends = F.when(rest != "", F.substring(rest, 1, 1)).when(i + 1 < F.size(pieces), ":")
            url = piece.rlike("(http|https|ftp)$") & F.startswith(rest, F.lit("//"))
            exempt = url | (piece.rlike(r"\p{Nd}$") & ends.rlike(r"\p{Nd}"))
            for name in namespaces:
                exempt = exempt | F.endswith(piece, F.lit(name))
            offends = ((double % 2 == 0) & (single % 2 == 0) & ends.isNotNull()
                       & ~ends.isin(" ", "\t") & ~exempt)
            found = F.when(state["found"].isNotNull(), state["found"]).when(offends, col)
            return F.struct(double.alias("double"), single.alias("single"), col.alias("col"),
                            found.alias("found"))

        start = F.struct(F.lit(0).alias("double"), F.lit(0).alias("single"), F.lit(0).alias("col"),
                         F.lit(None).cast("int").alias("found"))
        return F.array(F.aggregate(F.sequence(F.lit(1), F.size(pieces) - 1), start, step)["found"])

    body = F.regexp_replace(line, r"^[\s\p{Z}]+", "")
    suspect = line.rlike(SUSPECT) & (body != "") & ~body.startswith("#")
    return F.when(suspect, F.get(let(F.split(line, ":"), first), F.lit(0)))


def first_offence(text: Column, namespaces=NAMESPACES) -> Column:
    """``struct<line, col>`` of the first offence in a text, null when there is none."""
    judged = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        (i + 1).alias("line"), colon_offence(line, namespaces).alias("col")))
    return F.get(F.filter(judged, lambda j: j["col"].isNotNull()), F.lit(0))


def offence_message(at: Column) -> Column:
    """What a first offence is reported as; null when there is none."""
    return F.when(at.isNotNull(), F.concat(F.lit("no space after colon on line "), at["line"]))


def lint_findings(texts: DataFrame, keys: list, column: str, namespaces=NAMESPACES) -> DataFrame:
    """One finding per text with an offence, at its first offending line."""
    marked = texts.filter(F.col(column).rlike(SUSPECT)).select(
        *keys, first_offence(F.col(column), namespaces).alias("at"))
    return explode_findings(marked, keys, when_found(
        F.col("at").isNotNull(), "yaml_colon_lint", FAIL, offence_message(F.col("at"))))
