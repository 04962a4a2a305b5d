"""Values of metadata documents.

A document is kept as JSON text next to its parsed form, because the checks care
about what a typed struct loses: ``1`` against ``1.0``, a missing key against a
null one, and the order of keys.  Parsed values are VARIANTs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, INTEGER, NUMBER, BOOLEAN, STRING, LIST, OBJECT = (
    "null", "integer", "number", "boolean", "string", "list", "object")


#: JSON has no infinities and no NaN: they are the texts below.  A document's own text that begins with
#: this noncharacter has it twice in the JSON (see ``sources.documents``), so nothing else is taken for them.
NON_FINITE = "\ufdd0"
NON_FINITE_TEXTS = tuple(NON_FINITE + name for name in ("NaN", "Infinity", "-Infinity"))


def number_text(text: Column) -> Column:
    """JSON text of a bound, with infinities and NaN spelt as Spark casts them."""
    return F.regexp_replace(text, f'^"{NON_FINITE}(NaN|-?Infinity)"$', "$1")


def _kind_of_schema(schema: Column, value: Column) -> Column:
    # A whole number beyond 64 bits is stored as a decimal of 19 digits or more.
    return (
        F.when(schema.isNull() | (schema == "VOID"), NULL)
        .when(schema == "STRING", F.when(
            F.try_variant_get(value, "$", "string").isin(*NON_FINITE_TEXTS), NUMBER).otherwise(STRING))
        .when(schema == "BIGINT", INTEGER)
        .when(schema.startswith("ARRAY"), LIST)
        .when(schema.startswith("OBJECT"), OBJECT)
        .when(schema == "BOOLEAN", BOOLEAN)
        .when(schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), INTEGER)
        .otherwise(NUMBER))


def kind(value: Column) -> Column:
    """Name of a value's kind; a missing value counts as null."""
    # Bound as a lambda variable, so the schema is worked out once.
    return F.get(F.transform(F.array(F.schema_of_variant(value)), lambda schema: _kind_of_schema(schema, value)), F.lit(0))


def plain_kind(value: Column) -> Column:
    """The same without a lambda, for a projection: Spark works its schema out once there and compiles the rest."""
    return _kind_of_schema(F.schema_of_variant(value), value)


def is_null(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))


def json_text(value: Column) -> Column:
    return F.to_json(value)


BLANK_TEXTS = ("null", '""', "[]", "{}")
FALSY_TEXTS = (*BLANK_TEXTS, "false", "0", "0.0", "-0.0")


def falsy_text(text: Column) -> Column:
    return F.coalesce(text.isin(*FALSY_TEXTS), F.lit(True))


def blank_text(text: Column) -> Column:
    return F.coalesce(text.isin(*BLANK_TEXTS), F.lit(True))


def is_falsy(value: Column) -> Column:
    """Missing, null, empty text, zero, false, or an empty container.  Most values are told by their plain text;
    JSON, which tells a text from a number, is written only of those that look empty."""
    return is_falsy_by(plain_text(value), value)


def plain_text(value: Column) -> Column:
    """A scalar's text, with the mark of values that JSON cannot hold."""
    return F.try_variant_get(value, "$", "string")


def is_falsy_by(plain: Column, value: Column) -> Column:
    """``is_falsy`` of a value whose plain text is known."""
    return F.when(plain.isin("", *FALSY_TEXTS).eqNullSafe(False), False).otherwise(falsy_text(json_text(value)))


def is_blank(value: Column) -> Column:
    """Missing, null, empty text or an empty container (zero and false count)."""
    return blank_text(json_text(value))


def as_text(value: Column) -> Column:
    """A scalar as text: as the document has it, numbers that are not finite by their names."""
    return F.regexp_replace(plain_text(value), f"^{NON_FINITE}", "")


def unmarked(plain: Column) -> Column:
    """The same of a plain text that is a column or bound: it is looked at twice."""
    return F.when(plain.startswith(NON_FINITE), F.substring(plain, 2, 2**31 - 1)).otherwise(plain)


def text_of_string(value: Column) -> Column:
    """The text of a value that is one, else null."""
    plain = plain_text(value)
    return F.when((F.schema_of_variant(value) == "STRING") & ~plain.isin(*NON_FINITE_TEXTS), as_text(value))


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def member(value: Column, key: str) -> Column:
    """Value of an object's key; null when absent or when it is no object."""
    return F.try_variant_get(value, f"$.{key}", "variant")
