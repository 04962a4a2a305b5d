"""Rules for column and table names.

Each rule maps a name column to an array of findings, so a suite over any number
of names is one narrow projection.  Rules come in as literals (see ``rules``),
which replaces the name x rule join by a loop over a small constant array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate import rules as R
from tablegate.functions.findings import (
    FAIL, WARN, all_of, explode_findings, for_each, no_findings, state, when_found,
)
from tablegate.functions.text import (
    RULE_WORD_TYPE, let, literal_rows, may_share, measured, near, ratio_to_word, rule_word, squash,
    tokens, word_masks,
)
from tablegate.rules import DEFAULT_RULES, RuleBook


def name_length(name: Column) -> Column:
    size = F.length(name)
    return F.when(
        size > R.MAX_NAME_LENGTH,
        when_found(F.lit(True), "name_length", FAIL,
                   F.concat(F.lit("too long: "), size, F.lit(f" of {R.MAX_NAME_LENGTH}"))),
    ).otherwise(
        when_found(size > R.WARN_NAME_LENGTH, "name_length", WARN,
                   F.concat(F.lit("long: "), size, F.lit(f" of {R.MAX_NAME_LENGTH}"))))


def name_no_decimals(name: Column) -> Column:
    return when_found(F.contains(name, F.lit(".")), "name_no_decimals", FAIL,
                      "contains a decimal point")


def name_alpha_start(name: Column) -> Column:
    return when_found(~name.rlike(r"\A\p{L}"), "name_alpha_start", FAIL,
                      "does not start with a letter")


def without_known_words(name: Column, book: RuleBook) -> Column:
    """The name after deleting every filter name, then every exception word."""
    known = [word.name for word in (*book.filters, *book.exceptions)]
    if not known:
        return name
    rest = F.aggregate(
        literal_rows(known, "array<string>"), name,
        lambda rest, word: F.replace(rest, word, F.lit("")))
    if all(any(char.isupper() for char in word) for word in known):
        # Nothing to delete from a name without capitals.
        return F.when(name.rlike(r"\p{Lu}"), rest).otherwise(name)
    return rest


def name_snake_case(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    rest = without_known_words(name, book)
    lower = rest.rlike(r"\p{Ll}") & ~rest.rlike(r"[\p{Lu}\p{Lt}]")
    plain = F.replace(name, F.lit("_"), F.lit(""))
    check = "name_snake_case"
    return all_of(
        when_found(F.endswith(name, F.lit("_")), check, FAIL, "ends with an underscore"),
        when_found(F.startswith(name, F.lit("_")), check, FAIL, "starts with an underscore"),
        when_found(F.contains(name, F.lit("__")), check, FAIL, "has repeated underscores"),
        when_found((rest != "") & ~lower, check, FAIL, "is not lower case"),
        when_found(~plain.rlike(r"\A[\p{L}\p{N}]+\z"), check, FAIL,
                   "has other than letters and digits"),
    )


def name_banned(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    if not book.banned:
        return no_findings()
    words = literal_rows([rule_word(word) for word in book.banned],
                         f"array<struct<{RULE_WORD_TYPE}>>")
    inside = F.filter(words, lambda r: F.contains(name, r["word"]))

    def score(token):
        close = F.filter(words, lambda r: (
            may_share(token, r, R.BANNED_WARN_RATIO)
            & near(token, r["word"], r["size"], R.BANNED_WARN_RATIO)))
        return F.transform(close, lambda r: F.struct(
            r["word"].alias("word"), ratio_to_word(token, r).alias("ratio")))

    def judged(scored: Column) -> Column:
        return F.when(F.size(scored) > 0, all_of(
            for_each(F.filter(scored, lambda s: s["ratio"] > R.BANNED_FAIL_RATIO),
                     "name_banned", FAIL, lambda s: F.concat(F.lit("resembles banned word "), s["word"])),
            for_each(F.filter(scored, lambda s: s["ratio"] > R.BANNED_WARN_RATIO),
                     "name_banned", WARN, lambda s: F.concat(F.lit("may be banned word "), s["word"])),
        )).otherwise(no_findings())

    scored = F.flatten(F.transform(F.transform(tokens(F.lower(name)), measured), score))
    return all_of(
        for_each(inside, "name_banned", FAIL,
                 lambda r: F.concat(F.lit("contains banned word "), r["word"])),
        let(scored, judged))


def name_protected(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    pairs = list(dict.fromkeys(
        (mistake, word.name) for word in book.protected for mistake in word.mistakes))
    if not pairs:
        return no_findings()
    rules = literal_rows(
        [{"mistake": mistake, "folded": mistake.lower(), "use": canonical}
         for mistake, canonical in pairs],
        "array<struct<mistake:string,folded:string,use:string>>")
    # Membership settles nearly all names without building findings.
    whole = F.when(
        name.isin([mistake for mistake, _ in pairs]),
        for_each(F.filter(rules, lambda r: r["mistake"] == name),
                 "name_protected", FAIL, lambda r: F.concat(F.lit("use "), r["use"])),
    ).otherwise(no_findings())
    folded = sorted({mistake.lower() for mistake, _ in pairs})
    suspects = F.filter(tokens(F.lower(name)), lambda token: token.isin(folded))
    partly = F.flatten(F.transform(suspects, lambda token: for_each(
        F.filter(rules, lambda r: r["folded"] == token),
        "name_protected", WARN, lambda r: F.concat(F.lit("did you mean "), r["use"]))))
    return all_of(whole, partly)


def name_exception_case(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    if not book.exceptions:
        return no_findings()
    plain = F.replace(name, F.lit("_"), F.lit(""))
    words = literal_rows([word.name for word in book.exceptions], "array<string>")
    wrong = let(plain, lambda p: F.filter(
        words, lambda w: F.contains(F.lower(p), F.lower(w)) & ~F.contains(p, w)))
    if all(word.name.isascii() for word in book.exceptions):
        # Nearly all names hold no such word in any case.
        inside = "|".join(rf"\Q{word.name.lower()}\E" for word in book.exceptions)
        wrong = F.when(F.lower(plain).rlike(inside), wrong).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(wrong) > 0, for_each(wrong, "name_exception_case", FAIL,
                                              lambda w: F.concat(F.lit("wrong case of "), w))).otherwise(no_findings())


#: A family of filter words and what all of them, or some of them, have in common.
FAMILY_TYPE = ("struct<least:int,longest:int,every:bigint,some:bigint,spare:int,rules:array<struct<"
               f"name:string,inverse:string,inverse_masks:map<string,bigint>,{RULE_WORD_TYPE}>>>")


def _families(book: RuleBook) -> Column:
    """An index of the filter rules: families of words with the same last part, with their lengths and
    character sets, so that a name meets only the rules of families it can match at all."""
    def squashed(text):
        return text.replace("_", "").lower()

    groups: dict[str, list[dict]] = {}
    for f in book.filters:
        rule = {"name": f.name, "inverse": squashed(f.inverse), "inverse_masks": word_masks(squashed(f.inverse)),
                **rule_word(squashed(f.name))}  # a reversed word has the same characters
        groups.setdefault(f.name.split("_")[-1].lower(), []).append(rule)
    rows = [{"least": min(r["size"] for r in rules), "longest": max(r["size"] for r in rules),
             "every": reduce(int.__and__, [r["bits"] for r in rules]), "some": reduce(int.__or__, [r["bits"] for r in rules]),
             "spare": max(r["spare"] for r in rules), "rules": rules} for rules in groups.values()]
    return literal_rows(rows, f"array<{FAMILY_TYPE}>")


def _can_hold(plain: Column, family: Column) -> Column:
    """Whether a name is long enough and has the characters to contain some word of a family."""
    return (plain["size"] >= family["least"]) & (plain["bits"].bitwiseAND(family["every"]) == family["every"])


def _can_resemble(plain: Column, family: Column, above: int) -> Column:
    """Necessary condition for a similarity above a percentage with some word of a family: that of
    ``may_share`` with the shortest word, all its members' characters and repetitions, and the longest word."""
    total, longest = plain["size"] + family["least"], family["longest"]
    shared = F.bit_count(plain["bits"].bitwiseAND(family["some"])).cast("int") + family["spare"]
    return ((plain["size"] * 200 >= total * above) & (shared * 200 >= total * above)
            & (longest * 200 >= (plain["size"] + longest) * above))


def _rules_of(families: Column, chosen, match) -> Column:
    """The matching rules of the chosen families; only matches are gathered."""
    return F.flatten(F.transform(F.filter(families, chosen), lambda f: F.filter(f["rules"], match)))


def _against_filters(name: Column, book: RuleBook, *checks) -> Column:
    """Checks of a name against the filter words, over its squashed form measured once."""
    if not book.filters:
        return no_findings()
    return let(squash(name), lambda text: let(measured(text), lambda plain: F.concat(
        *[check(plain, _families(book), name) for check in checks])))


def _inverse(plain: Column, families: Column, name: Column) -> Column:
    hits = _rules_of(families, lambda f: _can_hold(plain, f), lambda r: F.contains(plain["text"], r["inverse"]))
    return for_each(hits, "name_filter_inverse", FAIL, lambda r: F.concat(F.lit("reversed, use "), r["name"]))


def _case(plain: Column, families: Column, name: Column) -> Column:
    hits = _rules_of(families, lambda f: _can_hold(plain, f),
                     lambda r: F.contains(plain["text"], r["word"]) & ~F.contains(name, r["name"]))
    return for_each(hits, "name_filter_case", FAIL, lambda r: F.concat(F.lit("misspelt, use "), r["name"]))


def _fuzzy(plain: Column, families: Column, name: Column) -> Column:
    above = R.FILTER_WARN_RATIO
    close = _rules_of(families, lambda f: _can_resemble(plain, f, above), lambda r: may_share(plain, r, above) & (
        near(plain, r["word"], r["size"], above) | near(plain, r["inverse"], r["size"], above)))

    def judged(rules: Column) -> Column:
        scored = F.transform(rules, lambda r: F.struct(
            r["name"].alias("name"),
            F.greatest(ratio_to_word(plain, r), ratio_to_word(plain, r, "inverse", "inverse_masks")).alias("ratio")))
        return F.when(F.size(rules) > 0, let(scored, lambda s: all_of(
            for_each(F.filter(s, lambda x: x["ratio"] > R.FILTER_FAIL_RATIO), "name_filter_fuzzy", FAIL,
                     lambda x: F.concat(F.lit("resembles "), x["name"])),
            for_each(F.filter(s, lambda x: x["ratio"] > R.FILTER_WARN_RATIO), "name_filter_fuzzy", WARN,
                     lambda x: F.concat(F.lit("did you mean "), x["name"]))))).otherwise(no_findings())

    return let(close, judged)


def name_filter_inverse(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    return _against_filters(name, book, _inverse)


def name_filter_case(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    return _against_filters(name, book, _case)


def name_filter_fuzzy(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    return _against_filters(name, book, _fuzzy)


def column_name_checks(name: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    """All eight rules for column names; a null or empty name has no findings."""
    found = all_of(
        name_alpha_start(name), name_length(name), name_snake_case(name, book),
        name_no_decimals(name), _against_filters(name, book, _inverse, _case, _fuzzy), name_banned(name, book),
        name_exception_case(name, book), name_protected(name, book))
    return F.when(F.length(name) > 0, found).otherwise(no_findings())


def table_stem(file: Column) -> Column:
    """File name without its last suffix (a leading or trailing dot is no suffix)."""
    base = F.regexp_extract(file, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def table_name_checks(file: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    """The rules that apply to table names, on the stem of the file name."""
    return table_stem_checks(table_stem(file), book)


def table_stem_checks(stem: Column, book: RuleBook = DEFAULT_RULES) -> Column:
    """The same on a stem, which is looked at several times: best a column."""
    return all_of(
        name_alpha_start(stem), name_snake_case(stem, book), name_no_decimals(stem),
        name_exception_case(stem, book), name_protected(stem, book))


def validate_column_names(names: DataFrame, column: str = "name",
                          book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Findings per distinct name: ``name, check, severity, message``.

    Names repeat across tables, so they are deduplicated before any rule runs;
    join the result back on the name to reach tables or positions.
    """
    distinct = names.select(F.col(column).alias("name")).filter(F.length("name") > 0).distinct()
    return explode_findings(distinct, ["name"], column_name_checks(F.col("name"), book))


def column_name_states(names: DataFrame, column: str = "name",
                       book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Worst severity per distinct name, passes included."""
    distinct = names.select(F.col(column).alias("name")).filter(F.length("name") > 0).distinct()
    found = distinct.withColumn("found", column_name_checks(F.col("name"), book))
    return found.select("name", state(F.col("found")).alias("severity"))


def validate_table_names(files: DataFrame, column: str = "file",
                         book: RuleBook = DEFAULT_RULES) -> DataFrame:
    distinct = files.select(F.col(column).alias("file")).distinct()
    return explode_findings(distinct, ["file"], table_name_checks(F.col("file"), book))
