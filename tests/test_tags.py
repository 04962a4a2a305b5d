import itertools
import random

from pyspark.sql import functions as F

from tablegate.operators import infer, tags
from tablegate.sources.vocabulary import parse_vocabulary

VOCABULARY = """# type | name | description
Q | meta.id | Identifier
S | meta.main | Main value
Q | pos.eq.ra | Right ascension
E | phot.mag | Magnitude
S | em.opt.U | U band
P | stat.error | Error
X | odd.word | Neither"""


def vocabulary(spark):
    return parse_vocabulary(spark.createDataFrame([(line,) for line in VOCABULARY.split("\n")], "value string"))


def brute_repair(words, full):
    def valid(order):
        return words[order[0]][1] and all(words[i][2] for i in order[1:])
    best = []
    for size in range(1, len(words) + (1 if full else 0)):
        for order in itertools.permutations(range(len(words)), size):
            if valid(order) and len(order) > max(len(best), 1):
                best = order
    return ";".join(words[i][0] for i in best)


def test_repair_equals_the_search_over_all_arrangements(spark):
    rng = random.Random(4)
    cases = [[(f"w{i}", rng.random() < 0.5, rng.random() < 0.5) for i in range(rng.randint(1, 6))]
             for _ in range(400)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)],
                               "id int, words array<struct<word:string,is_primary:boolean,is_secondary:boolean>>")
    rows = df.select("id", tags.ucd_repair(F.col("words")).alias("a"),
                     tags.ucd_repair(F.col("words"), full=True).alias("b")).collect()
    for row in rows:
        assert row.a == brute_repair(cases[row.id], False), cases[row.id]
        assert row.b == brute_repair(cases[row.id], True), cases[row.id]


def test_tag_problems(spark):
    given = ["", "meta.id", "META.ID;meta.main", "meta.main", "meta.id;stat.error", "meta.id;nothing",
             "meta id", "nothing", ";meta.main", "meta.id;", "odd.word"]
    rows = tags.ucd_validate(spark.createDataFrame([(g,) for g in given], "ucd string"), vocabulary(spark))
    assert {r.ucd: r.message for r in rows.collect()} == {
        "meta.main": "not a primary word: meta.main",
        "meta.id;stat.error": "not a secondary word: stat.error",
        "meta.id;nothing": "unknown word nothing", "meta id": "invalid character  ",
        "nothing": "unknown word nothing", ";meta.main": "invalid word ", "meta.id;": "invalid word ",
        "odd.word": "unknown word odd.word"}


def test_guessed_tags_and_units(spark):
    names = ["uberID", "ra", "u_SDSS", "mag_u_SDSS", "mag_err", "plain", "u_SDSS_err", "mag_abs"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.ucd for r in infer.guess_ucd(frame, vocabulary(spark)).collect()}
    assert got == {"uberID": "meta.id;meta.main", "ra": "pos.eq.ra", "u_SDSS": "phot.mag;em.opt.U",
                   "mag_u_SDSS": "phot.mag;em.opt.U", "mag_err": "", "plain": "",
                   "u_SDSS_err": "stat.error;em.opt.U",
                   "mag_abs": ""}
    units = {r.name: r.unit for r in frame.select("name", infer.guess_unit(F.col("name")).alias("unit")).collect()}
    assert units["ra"] == "deg" and units["mag_abs"] == "mag" and units["plain"] == "--"
