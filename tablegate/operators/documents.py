"""Checks on table-metadata documents.

Input: ``file, raw`` with the document as JSON text (see ``sources.documents``).
``open_documents`` parses it once; every check is an array-of-findings Column over
the opened row, so the whole suite is one narrow pass.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate import rules as R
from tablegate.functions import kinds as K
from tablegate.functions.findings import (
    FAIL, all_of, explode_findings, explode_once, finding, for_each, no_findings, when_found,
)
from tablegate.functions.text import in_pieces, let, literal_rows
from tablegate.operators import names, tags
from tablegate.rules import AUTHOR_PATTERN, DEFAULT_RULES, RuleBook
from tablegate.sources.store import by_shuffle, stored

FIELD_ENTRY = "entries"


def open_documents(docs: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``keys`` (in document order), ``body`` (key -> value) and ``kinds`` (key ->
    kind); columns no check uses are pruned.  With ``only``, the body holds these keys alone: a
    check of few keys does not pay for the others."""
    opened = docs.withColumn("keys", F.json_object_keys("raw"))
    if only is None:
        body = F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>")
    else:
        opened = opened.withColumn("parsed", F.try_parse_json("raw"))
        body = F.map_from_arrays(F.array(*[F.lit(k) for k in only]),
                                 F.array(*[F.try_variant_get("parsed", f"$.{k}", "variant") for k in only]))
    opened = opened.withColumn("body", body).drop("parsed")
    # Lists and objects are told by their shape: the schema of all they hold is not worked out.
    return opened.withColumn("kinds", F.transform_values("body", lambda _, v: (
        F.when(K.as_list(v).isNotNull(), K.LIST).when(K.as_object(v).isNotNull(), K.OBJECT).otherwise(K.kind(v)))))


def value(key: str) -> Column:
    return F.col("body")[key]


def kind_of(key: str) -> Column:
    return F.coalesce(F.col("kinds")[key], F.lit(K.NULL))


def _text_list(items) -> Column:
    return literal_rows(list(items), "array<string>")


def _joined(items: Column) -> Column:
    return F.concat_ws(", ", items)


# --- presence, kind, closed sets ---------------------------------------------

def required(key: str, check: str = "doc_required") -> Column:
    return when_found(kind_of(key) == K.NULL, check, FAIL, f"{key} is missing")


def has_kind(key: str, expected: str, check: str = "doc_type") -> Column:
    found = kind_of(key)
    return when_found((found != expected) & (found != K.NULL), check, FAIL,
                      F.concat(F.lit(f"{key} must be {expected}, got "), found))


def required_kind(key: str, expected: str, check: str) -> Column:
    return all_of(required(key, check), has_kind(key, expected, check))


def optional_list(key: str, check: str = "doc_optional_list", held: Column | None = None) -> Column:
    """``held`` is the key's list where it is a column already."""
    found = kind_of(key)
    held = K.as_list(value(key)) if held is None else held
    return all_of(
        when_found(~found.isin(K.NULL, K.LIST), check, FAIL,
                   F.concat(F.lit(f"{key} must be list, got "), found)),
        when_found((found == K.LIST) & (F.size(held) == 0), check, FAIL,
                   f"{key} is an empty list"))


def empty_optionals(required_keys=R.DOCUMENT_REQUIRED) -> Column:
    return _empty_optionals(required_keys)


def _empty_optionals(required_keys=R.DOCUMENT_REQUIRED, suspect: Column | None = None) -> Column:
    """With ``suspect``, only documents that hold it are looked through key by key."""
    blank = F.filter(F.col("keys"), lambda k: (
        ~k.isin(list(required_keys)) & K.is_blank(F.col("body")[k])))
    blank = blank if suspect is None else F.when(suspect, blank)
    return when_found(F.size(blank) > 0, "doc_empty_optionals", FAIL,
                      F.concat(F.lit("present but empty: "), _joined(blank)))


def _may_be_blank(keys=R.DOCUMENT_KEYS, required_keys=R.DOCUMENT_REQUIRED) -> Column:
    """Necessary condition for an empty optional key, from the kinds: a key beside ``keys``, or one of them that is
    null, an object, an empty text or an empty list."""
    def may_be(key):
        found = kind_of(key)
        return (F.when(found == K.NULL, F.array_contains("keys", key)).when(found == K.LIST, F.size(_held(key)) == 0)
                .when(found == K.STRING, K.plain_text(value(key)) == "").otherwise(found == K.OBJECT))

    return reduce(or_, [may_be(key) for key in keys if key not in required_keys], F.col("unknown_key"))


def one_of(key: str, allowed, check: str) -> Column:
    text = K.as_text(value(key))
    is_text = kind_of(key) == K.STRING
    return all_of(
        required_kind(key, K.STRING, check),
        when_found(is_text & ~text.isin(list(allowed)), check, FAIL,
                   F.concat(F.lit(f"{key} not accepted: "), text)))


def survey(check: str = "doc_survey") -> Column:
    return one_of("survey", R.SURVEYS, check)


def license_name(check: str = "doc_license") -> Column:
    return one_of("license", R.LICENSES, check)


def description(check: str = "doc_description") -> Column:
    """Present and text; empty text passes."""
    return required_kind("description", K.STRING, check)


def non_empty_text(key: str, check: str) -> Column:
    empty = (kind_of(key) == K.STRING) & (K.as_text(value(key)) == "")
    return all_of(required_kind(key, K.STRING, check),
                  when_found(empty, check, FAIL, f"{key} is missing"))


# --- people and dates --------------------------------------------------------

_ATOM = r"[\p{L}\p{N}!#$%&'*+\-/=?^_`{|}~]+"
_LABEL = r"[\p{L}\p{N}]([\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?"
EMAIL_PATTERN = (rf"\A(?=[^@]{{1,64}}@)(?=.{{1,254}}\z){_ATOM}(\.{_ATOM})*@({_LABEL}\.)+{_LABEL}(?<=\p{{L}})\z")


def is_email(text: Column) -> Column:
    """Mail-address syntax: dotted atoms (64 characters at most), a dotted domain ending in a letter, 254 in all."""
    return text.rlike(EMAIL_PATTERN)


def author_problem(text: Column) -> Column:
    """What is wrong with ``Full Name <address>``, null when nothing is."""
    email = F.regexp_extract(text, AUTHOR_PATTERN, 1)
    return (F.when(~text.rlike(AUTHOR_PATTERN), F.lit("not 'Name <address>': "))
            .when(~is_email(email), F.lit("not a mail address: ")))


def author(key: str = "author", check: str = "doc_author") -> Column:
    text = F.when(kind_of(key) == K.STRING, K.as_text(value(key)))
    problem = author_problem(text)
    return all_of(required_kind(key, K.STRING, check),
                  when_found(problem.isNotNull(), check, FAIL, F.concat(problem, text)))


def _elements(key: str) -> Column:
    """Elements of a list value with their 1-based index; empty for anything else."""
    return F.coalesce(
        F.transform(K.as_list(value(key)), lambda item, i: F.struct((i + 1).alias("pos"), item.alias("item"))),
        F.array().cast("array<struct<pos:int,item:variant>>"))


def _coauthor_problem(item: Column, text: Column) -> Column:
    """What is wrong with a coauthor, null when nothing is; ``text`` is null for what is no text."""
    return (F.when(K.is_null(item), F.lit("missing"))
            .when(text.isNull(), F.lit("must be string"))
            .otherwise(F.concat(author_problem(text), text)))


def coauthors(key: str = "coauthors", check: str = "doc_coauthors") -> Column:
    def judge(entry):
        text = F.when(K.kind(entry["item"]) == K.STRING, K.as_text(entry["item"]))
        return F.struct(entry["pos"].alias("pos"), _coauthor_problem(entry["item"], text).alias("problem"))

    judged = F.transform(_elements(key), judge)
    return all_of(
        optional_list(key, check),
        for_each(F.filter(judged, lambda j: j["problem"].isNotNull()), check, FAIL,
                 lambda j: F.concat(F.lit(f"{key}["), j["pos"], F.lit("]: "), j["problem"])))


def is_iso_date(text: Column) -> Column:
    """Calendar dates ``YYYY-MM-DD`` / ``YYYYMMDD`` and week dates ``YYYY-Www[-D]`` /
    ``YYYYWww[D]``."""
    parts = [F.substring(text, *at) for at in ((1, 4), (5, 2), (7, 2))]
    week = F.regexp_extract(text, r"W(\d{2})", 1).try_cast("int")
    # 28 December always lies in the last week of its year.
    last_week = F.weekofyear(F.concat(F.substring(text, 1, 4), F.lit("-12-28")).try_cast("date"))
    valid = (F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date").isNotNull())
             .when(text.rlike(r"\A\d{8}\z"), F.concat_ws("-", *parts).try_cast("date").isNotNull())
             .when(text.rlike(r"\A(\d{4}-W\d{2}(-[1-7])?|\d{4}W\d{2}[1-7]?)\z"), (week >= 1) & (week <= last_week))
             .otherwise(False))
    return F.when(text.isNotNull(), F.coalesce(valid, F.lit(False)) & ~text.startswith("0000"))


def date(key: str = "date", check: str = "doc_date") -> Column:
    text = F.when(kind_of(key) == K.STRING, K.as_text(value(key)))
    return all_of(required_kind(key, K.STRING, check),
                  when_found(~is_iso_date(text), check, FAIL,
                             F.concat(F.lit("not an ISO date: "), text)))


# --- keys --------------------------------------------------------------------

def key_order(order=R.DOCUMENT_KEYS, check: str = "doc_key_order", suspect: Column | None = None) -> Column:
    """With ``suspect``, only documents that hold it are looked at; the same goes for ``no_extra_keys``."""
    expected = F.array_intersect(_text_list(order), F.col("keys"))
    actual = F.filter(F.col("keys"), lambda k: k.isin(list(order)))
    wrong = expected != actual
    return when_found(wrong if suspect is None else suspect & wrong, check, FAIL,
                      F.concat(F.lit("expected order: "), _joined(expected)))


def no_extra_keys(allowed=R.DOCUMENT_KEYS, check: str = "doc_no_extra_keys", suspect: Column | None = None) -> Column:
    extra = F.array_sort(F.array_except(F.col("keys"), _text_list(allowed)))
    extra = extra if suspect is None else F.when(suspect, extra)
    return when_found(F.size(extra) > 0, check, FAIL,
                      F.concat(F.lit("unexpected: "), _joined(extra)))


# --- scalars -----------------------------------------------------------------

def dataset(check: str = "doc_dataset") -> Column:
    return non_empty_text("dataset", check)


def table(check: str = "doc_table") -> Column:
    return non_empty_text("table", check)


def table_matches_file(check: str = "doc_table_matches_file", stem: Column | None = None) -> Column:
    stem = names.table_stem(F.col("file")) if stem is None else stem
    actual = F.when(kind_of("table") == K.STRING, K.as_text(value("table")))
    return when_found(~actual.eqNullSafe(stem), check, FAIL,
                      F.concat(F.lit("table should be "), stem))


def version_int(check: str = "doc_version_int") -> Column:
    return required_kind("version", K.INTEGER, check)


def schema_version(check: str = "doc_schema_version") -> Column:
    number = F.try_variant_get(value("MAML_version"), "$", "double")
    wrong = (kind_of("MAML_version") == K.NUMBER) & (number != F.lit(R.SCHEMA_VERSION))
    return all_of(required_kind("MAML_version", K.NUMBER, check),
                  when_found(wrong, check, FAIL, f"MAML_version should be {R.SCHEMA_VERSION}"))


# --- lists of objects --------------------------------------------------------

def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _object_problems(entry, keys) -> Column:
    """What is wrong with an element ``item`` that as an object is ``of``."""
    here = entry["of"]
    missing = [F.when(K.is_falsy(here[k]), F.array(F.lit(f"{k} is missing"))).otherwise(_no_texts()) for k in keys]
    extra = F.array_sort(F.array_except(F.map_keys(here), _text_list(keys)))
    extras = F.when(F.size(F.array_except(F.map_keys(here), _text_list(keys))) > 0,
                    F.array(F.concat(F.lit("unexpected "), _joined(extra)))).otherwise(_no_texts())
    # An object is empty by its size; only what is none is looked at further.
    return (F.when(F.size(here) > 0, F.concat(*missing, extras))
            .when(here.isNotNull() | K.is_falsy(entry["item"]), F.array(F.lit("empty")))
            .otherwise(F.array(F.lit("must be object"))))


def _object_list(key: str, keys, check: str) -> Column:
    """Every element an object with all of ``keys`` filled and no others."""
    def open_item(entry):
        return F.struct(entry["pos"].alias("pos"), entry["item"].alias("item"), K.as_object(entry["item"]).alias("of"))

    def judge(entry):
        label = F.concat(F.lit(f"{key}["), entry["pos"], F.lit("]: "))
        return F.transform(_object_problems(entry, keys), lambda p: F.concat(label, p))

    problems = F.flatten(F.transform(F.transform(_elements(key), open_item), judge))
    return all_of(optional_list(key, check), for_each(problems, check, FAIL, lambda p: p))


def dois(check: str = "doc_dois") -> Column:
    return _object_list("DOIs", R.DOI_KEYS, check)


def depends(check: str = "doc_depends") -> Column:
    return _object_list("depends", R.DEPENDS_KEYS, check)


def _filled_list(key: str, check: str) -> Column:
    empty = F.filter(_elements(key), lambda e: K.is_falsy(e["item"]))
    return all_of(
        optional_list(key, check),
        for_each(empty, check, FAIL,
                 lambda e: F.concat(F.lit(f"{key}["), e["pos"], F.lit("]: empty"))))


def comments(check: str = "doc_comments") -> Column:
    return _filled_list("comments", check)


def keywords(check: str = "doc_keywords") -> Column:
    return _filled_list("keywords", check)


# --- fields ------------------------------------------------------------------

#: Parts of an entry that ask for the JSON text of several members, or for the qc object.
_SPELLED = {"qc_blank": ("qc",)}
_JUDGED = {"name": ("name",), "ucd": ("ucd",), "data_type": ("data_type",), "missing": R.FIELD_REQUIRED}
_OF_QC = ("qc_is_object", "qc_keys", "min_kind", "max_kind", "qc_min", "qc_max")


def _wanted(parts: tuple[str, ...] | None, *names: str) -> bool:
    return parts is None or any(name in parts for name in names)


def _keys_of(members: dict, parts: tuple[str, ...] | None) -> list[str]:
    return sorted({key for part, keys in members.items() if _wanted(parts, part) for key in keys})


def _looked_up(e, parts: tuple[str, ...] | None = None) -> dict[str, Column]:
    """The members of a field ``pos, item, of`` that its parts are read from, and their plain texts."""
    of = e["of"]
    texts = set(_keys_of(_JUDGED, parts)) | {key for key in ("unit", "info") if _wanted(parts, key)}
    spelled = set(_keys_of(_SPELLED, parts)) | ({"qc"} if _wanted(parts, *_OF_QC) else set())
    return {"pos": e["pos"], "item": e["item"], "of": of,
            **{f"plain_{key}": K.plain_text(of[key]) for key in sorted(texts)},
            **{f"value_{key}": of[key] for key in sorted(spelled | set(_keys_of(_JUDGED, parts)))}}


def _spelled_entry(e, parts: tuple[str, ...] | None = None) -> dict[str, Column]:
    """What the parts of a field are told by, from its members."""
    is_object = e["of"].isNotNull()
    judged = _keys_of(_JUDGED, parts)
    texts = sorted(set(judged) | {key for key in ("unit", "info") if _wanted(parts, key)})
    return {
        # An object is empty by its size, without writing it out.
        "pos": e["pos"], "empty": F.when(is_object, F.size(e["of"]) == 0).otherwise(K.is_falsy(e["item"])),
        "is_object": is_object,
        **({"keys": F.coalesce(F.map_keys(e["of"]), _no_texts())} if _wanted(parts, "keys") else {}),
        **{f"text_{key}": K.json_text(e[f"value_{key}"]) for key in _keys_of(_SPELLED, parts)},
        **{f"plain_{key}": e[f"plain_{key}"] for key in texts},
        **{f"falsy_{key}": K.is_falsy_by(e[f"plain_{key}"], e[f"value_{key}"]) for key in judged},
        **({"qc": K.as_object(e["value_qc"])} if _wanted(parts, *_OF_QC) else {})}


def _entry(e, parts: tuple[str, ...] | None = None, kind=K.kind) -> dict[str, Column]:
    """The wanted parts of a field that ``_spelled_entry`` has taken apart."""
    def filled(key):
        return F.when(~e[f"falsy_{key}"], K.unmarked(e[f"plain_{key}"]))

    def missing():
        lacking = reduce(or_, [e[f"falsy_{k}"] for k in R.FIELD_REQUIRED])
        return F.when(e["is_object"] & lacking, F.array_compact(F.array(*[
            F.when(e[f"falsy_{k}"], F.lit(k)) for k in R.FIELD_REQUIRED]))).otherwise(_no_texts())

    built = {
        "keys": lambda: e["keys"],
        "name": lambda: filled("name"),
        "missing": missing,
        "unit": lambda: K.unmarked(e["plain_unit"]),
        "info": lambda: K.unmarked(e["plain_info"]),
        "ucd": lambda: filled("ucd"),
        "data_type": lambda: filled("data_type"),
        "qc_blank": lambda: K.blank_text(e["text_qc"]),
        "qc_is_object": lambda: e["qc"].isNotNull(),
        "qc_keys": lambda: F.coalesce(F.map_keys(e["qc"]), _no_texts()),
        "min_kind": lambda: kind(e["qc"]["min"]),  # null of what is no object
        "max_kind": lambda: kind(e["qc"]["max"]),
        "qc_min": lambda: K.number_text(K.json_text(e["qc"]["min"])),
        "qc_max": lambda: K.number_text(K.json_text(e["qc"]["max"])),
    }
    return {**{name: e[name] for name in ("pos", "empty", "is_object")},
            **{name: build() for name, build in built.items() if _wanted(parts, name)}}


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[column.alias(name) for name, column in columns.items()])


def _field_entries(parts: tuple[str, ...] | None = None) -> Column:
    def unpack(e):
        return F.struct(e["pos"].alias("pos"), e["item"].alias("item"), K.as_object(e["item"]).alias("of"))

    # In steps, so that the members are looked up in maps built once per field.
    looked_up = F.transform(F.transform(_elements("fields"), unpack), lambda e: _struct(_looked_up(e, parts)))
    spelled = F.transform(looked_up, lambda e: _struct(_spelled_entry(e, parts)))
    return F.transform(spelled, lambda e: _struct(_entry(e, parts)))


def open_fields(opened: DataFrame, parts: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``entries``: the document's fields, each value looked up once.  ``parts`` names what of
    an entry is wanted besides ``pos``, ``empty`` and ``is_object``; the rest is not worked out."""
    return opened.withColumn(FIELD_ENTRY, _field_entries(parts))


def _label(e) -> Column:
    return F.concat(F.lit("fields["), e["pos"], F.lit("]: "))


def _usable(e) -> Column:
    return ~e["empty"] & e["is_object"]


def _in_fields(problems, check: str) -> Column:
    """The findings of a check that maps a field to the texts of its problems."""
    return F.flatten(F.transform(F.col(FIELD_ENTRY), lambda e: for_each(
        problems(e), check, FAIL, lambda p: F.concat(_label(e), p))))


def _shape_problems(e) -> Column:
    return (F.when(e["empty"], F.array(F.lit("empty")))
            .when(~e["is_object"], F.array(F.lit("must be object"))).otherwise(_no_texts()))


def fields_shape(check: str = "fields_shape") -> Column:
    return all_of(required("fields", check), optional_list("fields", check), _in_fields(_shape_problems, check))


def _required_problems(e) -> Column:
    return F.when(_usable(e) & (F.size(e["missing"]) > 0), F.transform(
        e["missing"], lambda k: F.concat(k, F.lit(" is missing")))).otherwise(_no_texts())


def fields_required(check: str = "fields_required") -> Column:
    return _in_fields(_required_problems, check)


def fields_duplicates(check: str = "fields_duplicates") -> Column:
    """Repeated names, citing the earlier positions: names are sorted, those with an equal neighbour
    are left, and each of their stretches is one group.  Linear but for the sort and the positions cited."""
    return _duplicates(F.col(FIELD_ENTRY), check)


def _duplicates(entries: Column, check: str = "fields_duplicates") -> Column:
    named = F.filter(entries, lambda e: _usable(e) & e["name"].isNotNull())
    ordered = F.array_sort(F.transform(named, lambda e: F.struct(e["name"].alias("name"), e["pos"].alias("pos"))))

    def same(a, b) -> Column:
        return F.coalesce(a["name"] == b["name"], F.lit(False))

    def groups(twins: Column) -> Column:
        starts = F.filter(F.transform(twins, lambda t, i: F.when(~same(F.get(twins, i - 1), t), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.slice(
            twins, i + 1, F.coalesce(F.get(at, k + 1), F.size(twins)) - i)))

    def later(group: Column) -> Column:
        rest = F.slice(group, F.lit(2), F.size(group) - 1)
        return F.transform(rest, lambda t, k: F.struct(t["pos"].alias("pos"), t["name"].alias("name"), F.transform(
            F.slice(group, F.lit(1), k + 1), lambda o: o["pos"].cast("string")).alias("at")))

    twins = let(ordered, lambda s: F.filter(s, lambda t, i: same(F.get(s, i - 1), t) | same(F.get(s, i + 1), t)))
    repeated = F.flatten(F.transform(let(twins, groups), later))
    return F.transform(repeated, lambda r: finding(check, FAIL, F.concat(
        _label(r), r["name"], F.lit(" repeats "), F.concat_ws(",", r["at"]))))


def _may_repeat() -> Column:
    """Necessary condition for a repeated name: names as the document has them that are equal, or one with the mark of
    values that JSON cannot hold, which are equal without it."""
    given = F.try_variant_get(value("fields"), "$", "array<struct<name:string>>")["name"]
    return F.coalesce((F.size(F.array_distinct(given)) < F.size(given))
                      | F.contains(F.array_join(given, ""), F.lit(K.NON_FINITE)), F.lit(False))


def _data_type_problems(e) -> Column:
    return F.when(_usable(e) & e["data_type"].isNotNull() & ~e["data_type"].isin(list(R.DATA_TYPES)),
                  F.array(F.concat(F.lit("unknown data_type "), e["data_type"]))).otherwise(_no_texts())


def fields_data_type(check: str = "fields_data_type") -> Column:
    return _in_fields(_data_type_problems, check)


def _extra_key_problems(e) -> Column:
    extra = F.array_except(e["keys"], _text_list(R.FIELD_KEYS))
    return F.when(_usable(e) & (F.size(extra) > 0), F.array(F.concat(
        F.lit("unexpected "), _joined(F.array_sort(extra))))).otherwise(_no_texts())


def fields_extra_keys(check: str = "fields_extra_keys") -> Column:
    return _in_fields(_extra_key_problems, check)


def _qc_problems(e) -> Column:
    none = _no_texts()
    extra = F.array_except(e["qc_keys"], _text_list(R.QC_KEYS))
    missing = F.concat(
        F.when(e["min_kind"] == K.NULL, F.array(F.lit("min"))).otherwise(none),
        F.when(e["max_kind"] == K.NULL, F.array(F.lit("max"))).otherwise(none))
    bounds = F.array(e["min_kind"], e["max_kind"])
    dtype = e["data_type"]
    value_problem = (
        F.when(F.size(missing) > 0,
               F.array(F.concat(F.lit("qc lacks "), _joined(missing))))
        .when(dtype.isNotNull() & ~dtype.isin([*R.INTEGER_TYPES, *R.FLOAT_TYPES]),
              F.array(F.concat(F.lit("qc on non-numeric type "), dtype)))
        .when(dtype.isin(list(R.INTEGER_TYPES)) & F.array_contains(bounds, K.NUMBER),
              F.array(F.lit("float qc on an integer field")))
        .when(dtype.isin(list(R.FLOAT_TYPES)) & F.array_contains(bounds, K.INTEGER),
              F.array(F.lit("integer qc on a float field")))
        .otherwise(none))
    extras = F.when(F.size(extra) > 0, F.array(F.concat(
        F.lit("qc has unexpected "), _joined(F.array_sort(extra))))).otherwise(none)
    problems = (
        F.when(e["qc_blank"], F.array(F.lit("qc is empty")))
        .when(~e["qc_is_object"], F.array(F.lit("qc must be object")))
        .otherwise(F.concat(extras, value_problem)))
    return F.when(_usable(e) & F.array_contains(e["keys"], "qc"), problems).otherwise(none)


def fields_qc(check: str = "fields_qc") -> Column:
    return _in_fields(_qc_problems, check)


def fields_names(check: str = "fields_names", book: RuleBook = DEFAULT_RULES) -> Column:
    """Column-name rules over the declared names, row by row.  For large document
    sets prefer ``field_name_findings``, which checks each distinct name once."""
    named = F.filter(F.col(FIELD_ENTRY), lambda e: e["name"].isNotNull())
    return F.flatten(F.transform(named, lambda e: F.transform(
        names.column_name_checks(e["name"], book),
        lambda f: F.struct(F.lit(check).alias("check"), f["severity"].alias("severity"),
                           F.concat(e["name"], F.lit(": "), f["message"]).alias("message")))))


FIELD_PARTS = ("name", "unit", "info", "ucd", "data_type", "qc_min", "qc_max")


def field_rows(opened: DataFrame, parts: tuple[str, ...] = FIELD_PARTS) -> DataFrame:
    """One row per declared field: ``file, pos, name, unit, info, ucd, data_type, qc_min, qc_max``, or
    only the ``parts`` asked for."""
    with_entries = open_fields(opened, parts) if FIELD_ENTRY not in opened.columns else opened
    rows = explode_once(with_entries, ["file"], F.col(FIELD_ENTRY), "e")
    return rows.select("file", "e.pos", *[f"e.{part}" for part in parts])


def declared(opened: DataFrame, key: str) -> DataFrame:
    """``file, pos`` and one text of every field that fills it, without unpacking the
    rest of the field."""
    items = explode_once(opened, ["file"], _elements("fields"), "e")
    held = items.select("file", F.col("e.pos").alias("pos"),
                        K.member(F.col("e.item"), key).alias("held"))
    return held.filter(~K.is_falsy(F.col("held"))).select(
        "file", "pos", K.as_text(F.col("held")).alias(key))


#: A value that stands in as many rows is not dealt out by itself: one task would get all of them.
FREQUENT = 100_000


def _meet(rows: DataFrame, of_value: DataFrame, keys: list[str], frequent: int = FREQUENT,
          counted: DataFrame | None = None) -> DataFrame:
    """Stored rows with the findings ``as`` of their value (those without any may stay, with a null).

    Rows of frequent values stay where they are: at most one value in ``frequent`` rows is such a one, so that side is
    broadcast.  The other rows are dealt out by value, and the outer join lets Spark broadcast the findings' side only:
    the stored rows, which are many times their files' size in memory, never go through the driver.  ``counted`` are the
    distinct values with the number ``n`` of their rows, where these are known.
    """
    if counted is None:
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    often = F.broadcast(counted.filter(F.col("n") >= frequent).select(*keys).join(of_value, keys, "left"))
    there = rows.join(often, keys)
    return there.unionByName(rows.join(often.drop("as"), keys, "left_anti").join(of_value, keys, "left"))


def field_name_findings(opened: DataFrame, book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Name-rule findings of declared fields: distinct names are checked once and the
    offending ones joined back."""
    rows = stored(declared(opened, "name").select("file", "name"))  # read twice, opened once
    bad = names.validate_column_names(rows, "name", book)
    of_name = bad.groupBy("name").agg(F.collect_list(F.struct("severity", "message")).alias("as"))
    met = _meet(rows, of_name, ["name"]).select("file", "name", F.inline_outer("as")).filter("severity IS NOT NULL")
    return met.select(
        "file", F.lit("fields_names").alias("check"), "severity",
        F.concat("name", F.lit(": "), "message").alias("message"))


# --- the row checks ------------------------------------------------------------

#: Keys of lists, the check of their elements, and of lists of objects the keys of these.
LIST_CHECKS = {"coauthors": "doc_coauthors", "DOIs": "doc_dois", "depends": "doc_depends", "comments": "doc_comments",
               "keywords": "doc_keywords"}
OBJECT_LISTS = {"DOIs": R.DOI_KEYS, "depends": R.DEPENDS_KEYS}
#: The checks of a field: what is wrong with it, as texts.
FIELD_CHECKS = {"fields_shape": _shape_problems, "fields_required": _required_problems, "fields_data_type": _data_type_problems,
                "fields_qc": _qc_problems, "fields_extra_keys": _extra_key_problems}


def _held(key: str) -> Column:
    """A key's list in a document opened by ``_open_suite``; null for anything else."""
    return F.col("lists")[key]


def _open_suite(docs: DataFrame, book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Documents opened for all checks: ``keys, body, lists`` (key -> elements), ``kinds`` (of the accepted keys), what the
    table rules find about the file's ``stem``, and whether some keys may be unknown or out of order.  All of it is
    worked out per document, none in a lambda, which Spark interprets."""
    def step(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({"file": in_pieces(F.col("file")), **columns})

    lists = (*LIST_CHECKS, "fields")
    opened = step(open_documents(docs), **{f"value_{key}": value(key) for key in R.DOCUMENT_KEYS}, stem=names.table_stem(F.col("file")))
    given = {key: F.col(f"value_{key}") for key in R.DOCUMENT_KEYS}
    opened = step(opened, lists=F.struct(*[K.as_list(given[key]).alias(key) for key in lists]),
                  unknown_key=F.size("keys") > reduce(add, [given[key].isNotNull().cast("int") for key in given]),
                  in_order=F.concat_ws(",", *[F.when(given[key].isNotNull(), key) for key in given]))
    kinds = [(F.when(_held(key).isNotNull(), K.LIST).otherwise(K.plain_kind(given[key]))
              if key in lists else K.plain_kind(given[key])).alias(key) for key in given]
    opened = step(opened, kinds=F.struct(*kinds), of_stem=names.table_stem_checks(F.col("stem"), book),
                  out_of_order=F.col("unknown_key") | (F.col("in_order") != F.array_join("keys", ",")))
    return opened.drop(*[f"value_{key}" for key in given], "in_order")


def document_checks() -> list[Column]:
    """The checks of a document but for the elements of its lists, over a row of ``_open_suite``."""
    of_stem = F.when(F.size("of_stem") > 0, F.transform(
        "of_stem", lambda f: F.struct(F.lit("doc_table_name").alias("check"), f["severity"].alias("severity"),
                                      f["message"].alias("message")))).otherwise(no_findings())
    repeated = F.when(_may_repeat(), _duplicates(_field_entries(("name",)))).otherwise(no_findings())
    unknown = F.col("unknown_key")
    return [
        survey(), dataset(), table(), of_stem, table_matches_file(stem=F.col("stem")), version_int(), date(),
        author(), description(), license_name(), schema_version(),
        *[optional_list(key, check, _held(key)) for key, check in LIST_CHECKS.items()],
        required("fields", "fields_shape"), optional_list("fields", "fields_shape", _held("fields")), repeated,
        no_extra_keys(suspect=unknown), _empty_optionals(suspect=_may_be_blank()), key_order(suspect=F.col("out_of_order")),
    ]


def unreadable(docs: DataFrame) -> Column:
    """The finding of an opened document that could not be read as a mapping."""
    reason = F.col("parse_error") if "parse_error" in docs.columns else F.lit(None).cast("string")
    return when_found(F.col("keys").isNull(), "src_documents", FAIL, F.concat(
        F.lit("not a readable mapping"), F.coalesce(F.concat(F.lit(": "), reason), F.lit(""))))


# --- one opening of a document -------------------------------------------------

FIELD_VALUES = ("pos", "name", "unit", "info", "ucd", "data_type", "qc_min", "qc_max")


def _scalar(key: str, kind: str, read: Column) -> Column:
    return F.when(kind_of(key) == kind, read).alias(key)


def _list_of(key: str, item, held: Column | None = None) -> Column:
    """A list value element by element; null for anything else and for an empty list."""
    held = K.as_list(value(key)) if held is None else held
    return F.when(F.size(held) > 0, F.transform(held, item))


def _plain_text(item: Column) -> Column:
    """A scalar's text; of lists and objects their JSON."""
    return F.coalesce(K.as_text(item), F.when(~K.is_null(item), K.json_text(item)))


#: The keys that a header is read from.
HEADER_KEYS = ("survey", "dataset", "table", "version", "date", "author", "coauthors", "DOIs", "depends",
               "description", "comments", "license", "keywords", "MAML_version")


def header(held=lambda key: None) -> Column:
    """An opened document's header as a typed struct.  A value of another kind than its key's is null, so
    that also a document with findings has a header.  ``held`` gives a key's list where it is a column already."""
    def texts(item):
        return _plain_text(item)

    def members(*names: tuple[str, str]):
        return lambda item: F.struct(*[_plain_text(K.member(item, key)).alias(name) for key, name in names])

    return F.struct(
        *[_scalar(key, K.STRING, K.as_text(value(key))) for key in ("survey", "dataset", "table")],
        _scalar("version", K.INTEGER, F.try_variant_get(value("version"), "$", "bigint")),
        *[_scalar(key, K.STRING, K.as_text(value(key))) for key in ("date", "author")],
        _list_of("coauthors", texts, held("coauthors")).alias("coauthors"),
        _list_of("DOIs", members(("DOI", "doi"), ("type", "doi_type")), held("DOIs")).alias("dois"),
        _list_of("depends", members(*[(k, k) for k in R.DEPENDS_KEYS]), held("depends")).alias("depends"),
        _scalar("description", K.STRING, K.as_text(value("description"))),
        _list_of("comments", texts, held("comments")).alias("comments"),
        _scalar("license", K.STRING, K.as_text(value("license"))),
        _list_of("keywords", texts, held("keywords")).alias("keywords"),
        _scalar("MAML_version", K.NUMBER, F.try_variant_get(value("MAML_version"), "$", "double")).alias("maml_version"))


def _element_problems(e) -> Column:
    """What is wrong with an element of a list of texts or objects; of a coauthor ``text`` is the text."""
    problem = _coauthor_problem(e["item"], e["text"])
    found = F.when(e["part"] == "coauthors", F.when(problem.isNotNull(), F.array(problem)).otherwise(_no_texts()))
    for key in LIST_CHECKS:
        if key != "coauthors":
            found = found.when(e["part"] == key, _object_problems(e, OBJECT_LISTS[key]) if key in OBJECT_LISTS else (
                F.when(K.is_falsy(e["item"]), F.array(F.lit("empty"))).otherwise(_no_texts())))
    return found.otherwise(_no_texts())


def typed_documents(docs: DataFrame, book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Every document opened once, as rows ``file, table, header, field, found``.

    One row stands for the document: its ``header`` (a typed struct; null when it is unreadable) and what the checks
    find about it as a whole.  Each element of its lists has a row of its own if there is something to say: a declared
    ``field`` that is an object, or findings.  Elements are rows and not arrays, as Spark compiles what is worked out of
    a row and interprets what is worked out of an array's element.  ``table`` is the name the document gives, on all its
    rows.  Findings, declared columns and headers are all read from here; keep it as a table (``sources.store.stored``)
    where more than one of them is wanted.
    """
    readable = F.col("keys").isNotNull()
    opened = _open_suite(docs, book)

    def row(**columns: Column) -> Column:
        none = {"part": "string", "pos": "int", "item": "variant"}
        return F.struct(*[columns.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in none.items()])

    def elements(key: str) -> Column:
        return F.coalesce(
            F.transform(_held(key), lambda item, i: row(part=F.lit(key), pos=i + 1, item=item)),
            F.array().cast("array<struct<part:string,pos:int,item:variant>>"))

    items = opened.select(
        "file", _scalar("table", K.STRING, K.as_text(value("table"))), F.when(readable, header(_held)).alias("header"),
        all_of(*document_checks()).alias("about"), unreadable(docs).alias("not_read"),
        F.concat(F.array(row()), *[elements(key) for key in (*LIST_CHECKS, "fields")]).alias("items"))

    # From here on a row is the document or an element.  Each step's columns are read by the next.
    is_document, is_field = F.col("part").isNull(), F.col("part") == "fields"
    whole = ("header", "about", "not_read")
    rows = items.select("file", "table", *whole, F.explode_outer("items").alias("i")).select(
        "file", "table", "i.part", "i.pos", "i.item", *[F.when(F.col("i.part").isNull(), F.col(name)).alias(name) for name in whole],
        F.when(F.col("i.part").isin("fields", *OBJECT_LISTS), K.as_object(F.col("i.item"))).alias("of"),
        F.when(F.col("i.part") == "coauthors", K.text_of_string(F.col("i.item"))).alias("text"))

    def step(df: DataFrame, columns: dict[str, Column], *also: str) -> DataFrame:
        kept = [name for name in ("table", "part", *whole, *also) if name not in columns]
        return df.select(in_pieces(F.col("file")).alias("file"), *kept, *[column.alias(name) for name, column in columns.items()])

    def of_row(df: DataFrame) -> dict[str, Column]:
        return {name: F.col(name) for name in df.columns}

    listed = step(rows, {"in_list": _element_problems(of_row(rows))}, "pos", "item", "of")
    # Rows of which nothing is to be said go.  A plain filter would be moved below, where the problems are worked out for it alone.
    said = listed.withColumn("said", F.when(is_document | is_field | (F.size("in_list") > 0), F.array(F.lit(True))))
    told = said.select(*listed.columns, F.explode_outer("said").alias("is_said")).filter("is_said")
    looked_up = step(told, _looked_up(of_row(told)), "in_list")
    spelled = step(looked_up, _spelled_entry(of_row(looked_up)), "in_list")
    entries = step(spelled, _entry(of_row(spelled), kind=K.plain_kind), "in_list")
    judged = step(entries, {
        "field": F.when(is_field & _usable(of_row(entries)), F.struct(*FIELD_VALUES)),
        **{check: F.when(is_field, problems(of_row(entries))) for check, problems in FIELD_CHECKS.items()}}, "pos", "in_list")

    label = F.concat(F.col("part"), F.lit("["), F.col("pos"), F.lit("]: "))
    list_check = F.element_at(F.create_map(*[F.lit(text) for pair in LIST_CHECKS.items() for text in pair]), F.col("part"))

    def findings(problems: str, check: Column) -> Column:
        return F.when(F.size(problems) > 0, F.transform(problems, lambda p: F.struct(
            check.alias("check"), F.lit(FAIL).cast("tinyint").alias("severity"), F.concat(label, p).alias("message")))
        ).otherwise(no_findings())

    of_document = F.when(F.size("not_read") > 0, F.col("not_read")).when(is_document, F.col("about")).otherwise(no_findings())
    return judged.select(in_pieces(F.col("file")).alias("file"), "table", "header", "field", F.concat(
        of_document, findings("in_list", list_check), *[findings(check, F.lit(check)) for check in FIELD_CHECKS]).alias("found"))


def _typed(docs: DataFrame, book: RuleBook = DEFAULT_RULES) -> DataFrame:
    return docs if "found" in docs.columns else typed_documents(docs, book)


# --- suites ------------------------------------------------------------------

def validate_documents(docs: DataFrame, vocabulary: DataFrame | None = None,
                       book: RuleBook = DEFAULT_RULES) -> DataFrame:
    """The document suite: ``file, check, severity, message``.

    Documents (``file, raw``, or the stored table of ``typed_documents``) are opened once.  Names and tags are
    checked once per distinct value, and only offending values are joined back, so that a name that stands
    in every document is one row on that side.
    """
    typed = docs if "found" in docs.columns else stored(typed_documents(docs, book).select("file", "field", "found"))
    keys = ["name"] + (["ucd"] if vocabulary is not None else [])
    rows = typed.filter(F.col("field").isNotNull()).select("file", F.inline_outer(F.array(*[F.struct(
        F.lit(key).alias("key"), F.col(f"field.{key}").alias("value"), F.col("field.pos").alias("pos")) for key in keys])))
    rows = rows.filter("value IS NOT NULL")
    counted = stored(rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")))  # the distinct values

    # A name's and a tag's findings in one shape, whatever found them.
    bad = names.validate_column_names(counted.filter("key = 'name'"), "value", book).select(
        F.lit("name").alias("key"), F.col("name").alias("value"), F.lit("fields_names").alias("as_check"),
        F.col("severity").alias("as_severity"), F.concat("name", F.lit(": "), "message").alias("as_message"))
    if vocabulary is not None:
        bad = bad.unionByName(tags.ucd_validate(counted.filter("key = 'ucd'"), vocabulary, "value").select(
            F.lit("ucd").alias("key"), F.col("ucd").alias("value"), F.lit("ucd_validate").alias("as_check"),
            F.lit(FAIL).cast("tinyint").alias("as_severity"), F.col("message").alias("as_message")))
    # A value's findings are one row (as many as the rules allow).
    of_value = bad.groupBy("key", "value").agg(F.collect_list(F.struct("as_check", "as_severity", "as_message")).alias("as"))
    met = _meet(rows, of_value, ["key", "value"], counted=counted).select(
        "file", "key", "pos", F.inline_outer("as")).filter("as_check IS NOT NULL")
    placed = F.concat(F.lit("fields["), "pos", F.lit("]: "), "as_message")
    judged = met.select(
        "file", F.col("as_check").alias("check"), F.col("as_severity").alias("severity"),
        F.when(F.col("key") == "ucd", placed).otherwise(F.col("as_message")).alias("message"))
    return typed.select("file", F.inline_outer("found")).filter("check IS NOT NULL").unionByName(judged)


def valid_documents(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """The documents about which nothing found is a failure."""
    failed = findings.filter(F.col("severity") == FAIL).select("file").distinct()
    return docs.join(by_shuffle(failed), "file", "left_anti")


def documents_to_fields(docs: DataFrame, findings: DataFrame, table: Column | None = None) -> DataFrame:
    """Declared columns of the valid documents: ``table, column, pos, unit, info, ucd,
    data_type, qc_min, qc_max``; of a repeated name the last declaration holds.  ``docs`` may be the
    table of ``typed_documents``, which is not opened again.  ``table`` tells the tables apart by
    something else than the name their document gives, such as its file."""
    key = F.col("table") if table is None else table
    declared = _typed(valid_documents(docs, findings)).filter(F.col("field.name").isNotNull()).select(
        key.alias("table"), F.col("field").alias("e"))
    return (declared.groupBy("table", F.col("e.name").alias("column"))
            .agg(F.max_by(F.col("e"), F.col("e.pos")).alias("e"))
            .select("table", "column", "e.pos", "e.unit", "e.info", "e.ucd", "e.data_type",
                    "e.qc_min", "e.qc_max"))


def documents_to_headers(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Typed headers: ``file, survey, dataset, table, version, date, author, coauthors, dois, depends,
    description, comments, license, keywords, maml_version``; of the valid documents where ``findings``
    are given, else of all that are readable (values of a wrong kind are null)."""
    chosen = docs if findings is None else valid_documents(docs, findings)
    if "found" not in chosen.columns:  # headers alone: neither fields nor checks are worked out
        chosen = open_documents(chosen, HEADER_KEYS).select(
            "file", F.when(F.col("keys").isNotNull(), header()).alias("header"))
    # A plain filter would be moved below the opening, where every document is made and read for it alone.
    return explode_once(chosen, ["file"], F.array("header"), "header").select("file", "header.*")


# --- accessors over the declared columns -------------------------------------

def get_fields(fields: DataFrame, wanted: DataFrame, attribute: str) -> DataFrame:
    """Attribute of the wanted columns (``table, column``); ``known`` is false for a
    column that is not declared."""
    have = fields.select("table", "column", F.col(attribute).alias("value"),
                         F.lit(True).alias("known"))
    return (wanted.join(have, ["table", "column"], "left")
            .select("table", "column", "value", F.coalesce("known", F.lit(False)).alias("known")))


def set_fields(fields: DataFrame, updates: DataFrame, attribute: str) -> DataFrame:
    """Fields with an attribute replaced (null included) where ``updates`` (``table, column,
    value``) names the column; of repeated updates the largest value holds.  An update of a
    column that is not declared is an error, raised when the result is computed."""
    new = updates.groupBy("table", "column").agg(F.max("value").alias("__new")).withColumn("__given", F.lit(True))
    joined = fields.withColumn("__known", F.lit(True)).join(new, ["table", "column"], "full")
    unknown = F.raise_error(F.concat(F.lit("unknown column "), F.coalesce("column", F.lit("null"))))
    value = (F.when(F.col("__known").isNull(), unknown.cast("string"))
             .when(F.col("__given"), F.col("__new")).otherwise(F.col(attribute)))
    return joined.withColumn(attribute, value).select(*fields.columns)
