"""Metadata inference: units, semantic tags and skeleton documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.functions.findings import explode_once
from tablegate.functions.text import literal_rows, tokens
from tablegate.operators.tags import is_valid, ucd_repair, vocab_join
from tablegate.rules import DATA_TYPES, DEFAULT_RULES, FLOAT_TYPES, INTEGER_TYPES, RuleBook

NO_UNIT = "--"
NO_INFO = "--"
BRIGHTNESS = "phot.mag"


def guess_unit(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    """Unit of the first protected word found: words of several tokens anywhere in
    the name, others as a whole token."""
    if not book.protected:
        return F.lit(NO_UNIT)
    rules = literal_rows(
        [{"name": w.name, "wide": "_" in w.name, "unit": w.units[0]} for w in book.protected],
        "array<struct<name:string,wide:boolean,unit:string>>")
    parts = tokens(name)
    hits = F.filter(rules, lambda r: F.when(r["wide"], F.contains(name, r["name"]))
                    .otherwise(F.array_contains(parts, r["name"])))
    return F.coalesce(F.get(hits, F.lit(0))["unit"], F.lit(NO_UNIT))


def tag_words(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    """Distinct tag words the rules suggest for a name, in rule order."""
    def tagged(entries):
        return literal_rows([{"name": n, "wide": "_" in n, "tag": tag} for n, tag in entries],
                            "array<struct<name:string,wide:boolean,tag:string>>")

    def pick(rules, match):
        return F.transform(F.filter(rules, match), lambda r: r["tag"])

    groups, parts = [], tokens(name)
    if book.exceptions:
        groups.append(pick(tagged([(w.name, w.tag) for w in book.exceptions]),
                           lambda r: F.contains(name, r["name"])))
    if book.protected:
        groups.append(pick(tagged([(w.name, ";".join(w.tags)) for w in book.protected]),
                           lambda r: F.when(r["wide"], F.contains(name, r["name"]))
                           .otherwise(F.array_contains(parts, r["name"]))))
    if book.filters:
        found = pick(tagged([(w.name, w.tag) for w in book.filters]),
                     lambda r: F.contains(name, r["name"]))
        groups.append(found)
    if not groups:
        return F.array().cast("array<string>")
    words = F.array_distinct(F.flatten(F.transform(F.concat(*groups), lambda t: F.split(t, ";"))))
    if not book.filters:
        return words
    # A lone filter band is a brightness in that band.
    joined = F.concat_ws(";", words)
    lone = (F.size(words) == 1) & (F.size(found) > 0) & ~F.contains(joined, F.lit(BRIGHTNESS))
    return F.when(lone, F.concat(F.array(F.lit(BRIGHTNESS)), words)).otherwise(words)


def guess_ucd(names: DataFrame, vocabulary: DataFrame, column: str = "name",
              book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Tag per distinct name: ``name, ucd`` (empty text when none can be made).

    The words of a name come from the rule book, so the array rebuilt per name is
    bounded by it; only names that match a rule are taken apart.
    """
    distinct = names.select(F.col(column).alias("name")).filter(F.length("name") > 0).distinct()
    parts = explode_once(distinct, ["name"], tag_words(F.col("name"), book), "pos", "word")
    regrouped = vocab_join(parts, vocabulary).groupBy("name").agg(F.array_sort(F.collect_list(
        F.struct("pos", "word", "is_primary", "is_secondary"))).alias("words"))
    words = F.col("words")
    plain = F.concat_ws(";", F.transform(words, lambda w: w["word"]))
    tagged = regrouped.select("name", F.when(is_valid(words), plain)
                              .otherwise(ucd_repair(words)).alias("ucd"))
    return distinct.join(tagged, "name", "left").select("name", F.coalesce("ucd", F.lit("")).alias("ucd"))


def infer_fields(profiles: DataFrame, vocabulary: DataFrame,
                 book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Field metadata for every profiled column: ``table, pos, name, data_type, unit,
    info, ucd, qc_min, qc_max, supported``.

    Only numeric columns with values get a range.  A column of an unsupported type
    keeps its row, flagged, instead of voiding the table.
    """
    numeric = F.col("dtype").isin([*INTEGER_TYPES, *FLOAT_TYPES])
    usable = numeric & F.col("min_value").isNotNull() & ~F.lower("max_value").isin("nan")
    fields = profiles.select(
        "table", "pos", F.col("column").alias("name"), F.col("dtype").alias("data_type"),
        guess_unit(F.col("column"), book).alias("unit"), F.lit(NO_INFO).alias("info"),
        F.when(usable, F.col("min_value")).alias("qc_min"),
        F.when(usable, F.col("max_value")).alias("qc_max"),
        F.col("dtype").isin(list(DATA_TYPES)).alias("supported"))
    tags = guess_ucd(fields, vocabulary, "name", book)
    return fields.join(tags, "name", "left").select(
        "table", "pos", "name", "data_type", "unit", "info",
        F.coalesce("ucd", F.lit("")).alias("ucd"), "qc_min", "qc_max", "supported")
