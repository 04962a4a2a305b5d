"""The index of filter words: it only spares comparisons, and loses none."""

import random

import pytest
from pyspark.sql import functions as F

from tablegate.operators import names
from tablegate.rules import DEFAULT_RULES, FilterName, RuleBook


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain(name, book):
    """All filter findings of a name, every word tried."""
    short, out = name.replace("_", "").lower(), set()
    for f in book.filters:
        word, inverse = (x.replace("_", "").lower() for x in (f.name, f.inverse))
        if inverse in short:
            out.add(("name_filter_inverse", 2, f"reversed, use {f.name}"))
        if word in short and f.name not in name:
            out.add(("name_filter_case", 2, f"misspelt, use {f.name}"))
        ratio = max(round(100 * (1 - (len(short) + len(w) - 2 * lcs(short, w)) / (len(short) + len(w)))) for w in (word, inverse))
        if ratio > 80:
            out.add(("name_filter_fuzzy", 2, f"resembles {f.name}"))
        if ratio > 70:
            out.add(("name_filter_fuzzy", 1, f"did you mean {f.name}"))
    return out


BOOKS = {
    "default": DEFAULT_RULES,
    "odd": RuleBook(filters=tuple(FilterName(n, "x") for n in (
        "a", "aaaa_a", "b_é", "É_b", "long_" + "xyz" * 30, "u_" + "q" * 70, "g_SDSS", "SDSS", "_", "c__d"))),
}


@pytest.mark.parametrize("book", BOOKS)
def test_no_match_is_lost(spark, book):
    rules = BOOKS[book]
    rnd, given = random.Random(7), {"", "_", "x"}
    for f in rules.filters:
        for start in (f.name, f.inverse, f.name.lower()):
            for _ in range(12):
                letters = list(start)
                for _ in range(rnd.randint(0, 4)):
                    at = rnd.randint(0, len(letters))
                    letters[at:at + rnd.randint(0, 2)] = rnd.choice(["", "_", "s", "d", "é", "a", "V"])
                given.add("".join(letters))
    given |= {"".join(rnd.choice("sdugrizvta_é") for _ in range(rnd.randint(1, 20))) for _ in range(300)}
    rows = spark.createDataFrame([(n,) for n in sorted(given)], "name string").repartition(4)
    checks = F.concat(names.name_filter_inverse(F.col("name"), rules), names.name_filter_case(F.col("name"), rules),
                      names.name_filter_fuzzy(F.col("name"), rules))
    together = names._against_filters(F.col("name"), rules, names._inverse, names._case, names._fuzzy)
    for row in rows.select("name", checks.alias("a"), together.alias("b")).collect():
        want = plain(row.name, rules) if row.name.replace("_", "") else None
        if want is not None:
            assert {tuple(f) for f in row.a} == want, row.name
        assert row.a == row.b
