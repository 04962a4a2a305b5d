"""Rule files: word lists in YAML, read into entries with places and errors, and into a rule book.

A file's name tells what it holds.  An entry that cannot be used keeps its row and says why, so
that a rule file is checked like any other document; the rule book takes sound entries only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.functions import kinds as K
from tablegate.functions.findings import explode_once
from tablegate.operators.documents import open_documents
from tablegate.operators.names import table_stem
from tablegate.rules import RuleBook
from tablegate.sources.documents import parse_documents, read_texts

#: What the files hold, by the stems of their names.
FILES = {"protected_words": "protected", "filters": "filters", "exceptions": "exceptions", "ucd_rules": "namespaces"}
#: The members an entry needs, and whether each is a list of texts.
MEMBERS = {
    "protected": {"common_mistakes": True, "ucd": True, "unit": True},
    "filters": {"secondary_ucd": False},
    "exceptions": {"ucd": False, "unit": False},
}


def _texts(value: Column) -> Column:
    """A list of texts; null if it is something else."""
    items = K.as_list(value)
    plain = F.forall(items, lambda i: K.kind(i) == K.STRING)
    return F.when(plain, F.transform(items, K.as_text))


def _one_or_many(value: Column) -> Column:
    return F.when(K.kind(value) == K.STRING, F.array(K.as_text(value))).otherwise(_texts(value))


def rule_entries(docs: DataFrame) -> DataFrame:
    """Entries of parsed rule files (``file, raw, parse_error``): ``file, kind, pos, name, common_mistakes,
    unit, ucd, error`` in the order of the files.  ``ucd`` and ``unit`` are lists whatever the kind; an entry
    without an error can be used.  A file that cannot be read, or is of no known name, is one row.
    """
    stem = table_stem(F.col("file"))
    names = F.create_map(*[F.lit(x) for pair in FILES.items() for x in pair])
    opened = open_documents(docs).withColumn("kind", F.element_at(names, stem))
    none = F.lit(None)

    def entry(name, value=none.cast("variant"), error=none.cast("string")):
        return F.struct(name.alias("name"), value.alias("value"), error.alias("error"))

    unread = F.array(entry(F.lit(None).cast("string"), error=F.coalesce("parse_error", F.lit("not a readable mapping"))))
    unknown = F.array(entry(F.lit(None).cast("string"), error=F.lit("no rule file of this name")))
    spaces = K.as_list(F.col("body")["namespaces"])
    namespaces = F.when(spaces.isNull(), F.array(entry(F.lit("namespaces"), error=F.lit("namespaces must be list")))).otherwise(
        F.transform(spaces, lambda v: entry(K.as_text(v), v, F.when(K.kind(v) != K.STRING, F.lit("must be string")))))
    entries = F.transform(F.col("keys"), lambda k: entry(k, F.col("body")[k]))
    items = (F.when(F.col("kind").isNull(), unknown).when(F.col("keys").isNull(), unread)
             .when(F.col("kind") == "namespaces", namespaces).otherwise(entries))
    rows = explode_once(opened, ["file", "kind"], items, "pos", "e")

    def problem(kind: str) -> Column:
        """The first member that is absent or of a wrong kind."""
        found = F.when(K.kind(F.col("e.value")) != K.OBJECT, F.lit("must be mapping"))
        for key, is_list in MEMBERS[kind].items():
            held = K.member(F.col("e.value"), key)
            right = _texts(held).isNotNull() if is_list else K.kind(held) == K.STRING
            found = found.when(K.is_null(held), F.lit(f"{key} is missing")).when(
                ~F.coalesce(right, F.lit(False)), F.lit(f"{key} must be {'list of strings' if is_list else 'string'}"))
        return found

    error = F.col("e.error")
    for kind in MEMBERS:
        error = F.when((F.col("kind") == kind) & F.col("e.error").isNull(), problem(kind)).otherwise(error)
    value = F.col("e.value")
    tag = F.coalesce(K.member(value, "ucd"), K.member(value, "secondary_ucd"))
    return rows.select(
        "file", "kind", "pos", F.col("e.name").alias("name"), _texts(K.member(value, "common_mistakes")).alias("common_mistakes"),
        _one_or_many(K.member(value, "unit")).alias("unit"), _one_or_many(tag).alias("ucd"), error.alias("error"))


def read_rules(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The entries of the rule files under a path or several."""
    return rule_entries(parse_documents(read_texts(spark, path)))


def rule_book(entries: DataFrame, strict: bool = True) -> RuleBook:
    """The rule book of the entries; kinds without a file keep the default words.

    Rules are literals of the plans they are used in, so this is the one place where they come to the driver.
    With ``strict`` an entry with an error is one here; else it is left out.
    """
    rows = entries.orderBy("file", "pos").collect()
    wrong = [f"{r.file}: {r.name}: {r.error}" for r in rows if r.error is not None]
    if strict and wrong:
        raise ValueError("; ".join(wrong[:10]))
    held: dict[str, dict] = {}
    for r in rows:
        if r.error is None:
            held.setdefault(r.kind, {})[r.name] = r
    given: dict[str, object] = {}
    if "protected" in held:
        given["protected"] = {n: {"common_mistakes": r.common_mistakes, "unit": r.unit, "ucd": r.ucd} for n, r in held["protected"].items()}
    if "filters" in held:
        given["filters"] = {n: {"secondary_ucd": r.ucd[0]} for n, r in held["filters"].items()}
    if "exceptions" in held:
        given["exceptions"] = {n: {"unit": r.unit[0], "ucd": r.ucd[0]} for n, r in held["exceptions"].items()}
    if "namespaces" in held:
        given["namespaces"] = list(held["namespaces"])
    return RuleBook.from_mappings(**given)
