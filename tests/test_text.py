import random

from pyspark.sql import functions as F

from tablegate.functions import text as X
from tablegate.operators import names as N
from tablegate.rules import BANNED_WORDS, DEFAULT_RULES, ProtectedWord, RuleBook


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    total = len(a) + len(b)
    return 100 if total == 0 else round((1.0 - (total - 2 * lcs(a, b)) / total) * 100)


def random_word(rng, longest, alphabet="abcdé_1"):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))


def test_fuzzy_ratio_equals_the_full_table(spark):
    rng = random.Random(1)
    pairs = [(random_word(rng, 14), random_word(rng, 14)) for _ in range(1500)]
    pairs += [("", ""), ("", "a"), ("a", ""), ("thing", "things"), ("duff", "dufff")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", X.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == ratio(r.a, r.b) for r in rows)


def test_fuzzy_ratio_beyond_the_mask_width(spark):
    rng = random.Random(2)
    pairs = [("x" * 3 + random_word(rng, 90, "abc") + "y" * 70, random_word(rng, 90, "abc") + "y" * 65)
             for _ in range(8)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", X.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == ratio(r.a, r.b) for r in rows)


def test_prefilters_lose_no_fuzzy_match(spark):
    """Every name close to a filter or banned word is found, by brute force over all."""
    rng = random.Random(3)
    base = [f.name for f in DEFAULT_RULES.filters] + list(BANNED_WORDS)
    names = set()
    for word in base:
        for _ in range(12):
            chars = list(word)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(chars) + 1)
                chars[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "_", "é", "S"])
            names.add("".join(chars) or "x")
    found = N.validate_column_names(spark.createDataFrame([(n,) for n in names], "name string")).filter(
        F.col("check").isin("name_filter_fuzzy", "name_banned")).collect()
    got = sorted((r.name, r.check, r.severity, r.message) for r in found)
    want = []
    for name in names:
        plain = name.replace("_", "").lower()
        for f in DEFAULT_RULES.filters:
            best = max(ratio(f.name.replace("_", "").lower(), plain),
                       ratio(f.inverse.replace("_", "").lower(), plain))
            if best > 80:
                want.append((name, "name_filter_fuzzy", 2, f"resembles {f.name}"))
            if best > 70:
                want.append((name, "name_filter_fuzzy", 1, f"did you mean {f.name}"))
        for word in BANNED_WORDS:
            if word in name:
                want.append((name, "name_banned", 2, f"contains banned word {word}"))
            for token in name.split("_"):
                score = ratio(word, token.lower())
                if score > 85:
                    want.append((name, "name_banned", 2, f"resembles banned word {word}"))
                if score > 80:
                    want.append((name, "name_banned", 1, f"may be banned word {word}"))
    assert got == sorted(want) and len(want) > 300


def checks_of(spark, names, file=False):
    """(check, severity) pairs per name, all names checked in one job."""
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    found = N.validate_table_names(frame, "name") if file else N.validate_column_names(frame)
    out = {n: set() for n in names}
    for r in found.collect():
        out[r.file if file else r.name].add((r.check, r.severity))
    return out


def test_name_edges(spark):
    clean = ["", "mass", "ångström"]
    faulty = {
        "_x": ("name_snake_case", 2), "x_": ("name_snake_case", 2), "a__b": ("name_snake_case", 2),
        "1a": ("name_alpha_start", 2), "W1_WISE_2": ("name_snake_case", 2),
        "SDSS_u": ("name_filter_inverse", 2), "mag_u_sdss": ("name_filter_case", 2),
        "uberid": ("name_exception_case", 2), "ra_deg": ("name_protected", 2),
        "things": ("name_banned", 2), "a.b": ("name_no_decimals", 2), "velocity_x": ("name_protected", 1),
    }
    got = checks_of(spark, [*clean, *faulty, "W1_WISE", "mag_r_SDSS", *["q" * n for n in (30, 31, 50, 51)]])
    assert all(got[name] == set() for name in clean)
    for name, expected in faulty.items():
        assert expected in got[name], name
    assert ("name_snake_case", 2) not in got["W1_WISE"]
    assert got["mag_r_SDSS"] == {("name_filter_fuzzy", 1)}  # close to the bare filter name
    lengths = [{c for c in got["q" * n] if c[0] == "name_length"} for n in (30, 31, 50, 51)]
    assert lengths == [set(), {("name_length", 1)}, {("name_length", 1)}, {("name_length", 2)}]


def test_table_names_use_the_stem_and_fewer_rules(spark):
    got = checks_of(spark, ["q" * 60 + ".parquet", "things.parquet", "a.b.parquet"], file=True)
    assert got["q" * 60 + ".parquet"] == got["things.parquet"] == set()
    assert ("name_no_decimals", 2) in got["a.b.parquet"]


def test_rule_books_of_any_size(spark):
    book = RuleBook(banned=(*(f"w{i}" for i in range(3000)), "x" * 63, "ab" * 100))
    rows = spark.createDataFrame([("x" * 63,), ("ab" * 99 + "ac",), ("y" * 70,)], "name string")
    found = {r.name: r.n for r in rows.select("name", F.size(N.name_banned(F.col("name"), book=book)).alias("n")).collect()}
    assert found["x" * 63] and found["ab" * 99 + "ac"] and not found["y" * 70]


def test_rule_book_from_mappings():
    book = RuleBook.from_mappings(protected={"t": {"common_mistakes": ["tt", "tt"], "unit": ["s"], "ucd": ["time"]}})
    assert book.protected == (ProtectedWord("t", ("tt",), ("s",), ("time",)),)


def test_masks_of_a_pair_are_worked_out_once(spark):
    """Not for every character of the longer text."""
    import time

    from pyspark.sql import functions as F

    from tablegate.functions.text import fuzzy_ratio

    pairs = spark.range(2000, numPartitions=8).select(
        F.repeat(F.concat(F.lit("ab"), "id"), 200).alias("a"), F.substring(F.repeat(F.lit("bcdefgha"), 8), 1, 60).alias("b"))
    start = time.perf_counter()
    assert pairs.select(F.sum(fuzzy_ratio(F.col("a"), F.col("b")))).first()[0] is not None
    assert time.perf_counter() - start < 20
