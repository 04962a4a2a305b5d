"""Secret scans by linking the parts of a credential.

1. Parts.  One pass over each whole text finds candidate spans and their scope (a paragraph: lines
   without an empty line between them).  A part is an identifier, a secret or an endpoint.
   The base kinds ``assign``, ``access`` and ``hex`` are reported in any case; the weak kinds
   ``ident``, ``short``, ``blob`` and ``endpoint`` are too common in plain prose to stand alone.
2. Linking.  An interval join of the weak parts with the parts of the other roles: in the same
   scope, starting at most ``reach`` characters away.  Parts are first aggregated to the least and the
   greatest start of a role in each bin of ``reach`` characters; a part's partners are then in its own
   bin (always in reach) or in one of its two neighbours, whose nearest start decides.  So each part
   meets at most three rows for a role, and no pairs of parts are made, exact as the result is.
3. A weak part is reported when its complement is there: a strong part of another role (``access``, an
   identifier; ``assign``, a secret), or parts of both other roles.

Only parts are shuffled, keyed by the row's number, so that neither a hot key nor copies of a
text meet in a group.

Defined cases: a null or empty text has no spans; each repeated row is reported alike; equal
spans of one kind are one span; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored, whatever their names; a ``doc_id`` may be null.  Places are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import discard, slices, stored, whole

REACH = 400
#: Kinds in the order of equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "short", "blob", "endpoint")
BASE = KINDS[:3]
#: What part of a credential a kind is, and the kinds that need one partner only.
ROLES = {"access": "identifier", "ident": "identifier", "endpoint": "endpoint",
         "assign": "secret", "hex": "secret", "short": "secret", "blob": "secret"}
STRONG = ("assign", "access")
LEAST = {"assign": 12, "access": 18, "hex": 16, "short": 6}

ANY_CASE = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ANY_CASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
#: Weak kinds: a named account, an unlabelled token, a place to log in (by its scheme, its name or its number).
IDENT = re.compile(
    r"""\b(?:access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._+-]{3,}""",
    ANY_CASE)
BLOB = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
SCHEME = re.compile(
    r"""\b(?:https?|ftp|jdbc:[a-z0-9]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", ANY_CASE)
HOST = re.compile(
    r"""\b(?:host(?:name)?|endpoint|server|base_?url|bucket)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._:/-]{3,}""", ANY_CASE)
ADDRESS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?![0-9.])")
#: What a text that matches has to hold in lower case; a search for it is far faster than the pattern.
HINTS = {
    ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"), ACCESS: ("akia",),
    IDENT: ("access", "client", "account", "user", "login"), SCHEME: ("://",),
    HOST: ("host", "endpoint", "server", "base", "bucket")}
SCOPE = re.compile(r"\n[ \t\r]*\n\s*")
#: Least Shannon entropy of an unlabelled token, bits a character.
ENTROPY = 3.5

SPANS = "array<struct<start:long,kind:int,end:long,scope:long>>"


def _random(token: str) -> bool:
    """Upper and lower case and digits mixed, as in a drawn token, not in a word or a path."""
    if not (any(c.isdigit() for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)):
        return False
    return sum(-n / len(token) * log2(n / len(token)) for n in Counter(token).values()) >= ENTROPY


def parts(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all candidate spans of a text, in order."""
    found, low = set(), text.lower()

    def matches(pattern: re.Pattern) -> Iterator[re.Match]:
        return pattern.finditer(text) if any(x in low for x in HINTS[pattern]) else iter(())

    for m in matches(ASSIGN):
        if len(m[2]) >= LEAST["assign"]:
            found.add((m.start(), 0, m.end()))
        elif len(m[2]) >= LEAST["short"]:
            found.add((m.start(), 4, m.end()))
    found |= {(m.start(), 1, m.end()) for m in matches(ACCESS) if m.end() - m.start() >= LEAST["access"]}
    found |= {(m.start(), 2, m.end()) for m in HEX.finditer(text)}
    found |= {(m.start(), 3, m.end()) for m in matches(IDENT)}
    taken = sorted((a, b) for a, _, b in found)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
    for m in BLOB.finditer(text):
        k = int(np.searchsorted(starts, m.start(), "right"))
        if (not k or ends[k - 1] < m.end()) and _random(m[0]):  # not the value of another span
            found.add((m.start(), 5, m.end()))
    found |= {(m.start(), 6, m.end()) for pattern in (SCHEME, HOST) for m in matches(pattern)}
    found |= {(m.start(), 6, m.end()) for m in ADDRESS.finditer(text)
              if not m.start() or text[m.start() - 1] not in "0123456789."}
    return sorted(found)


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):  # an id travels as text: a null among whole numbers would make them floats
        out = []
        for text in frame["text"]:
            spans = parts(text)
            breaks = [m.start() for m in SCOPE.finditer(text)] if spans else []
            scope = np.searchsorted(breaks, [s for s, _, _ in spans], "left")
            out.append([{"start": a, "kind": k, "end": b, "scope": int(z)} for (a, k, b), z in zip(spans, scope)])
        yield pd.DataFrame({"id": frame["id"], "found": out})


def _named(kind: Column, values: dict[str, object]) -> Column:
    """A kind's value, by its number."""
    return F.element_at(F.array(*[F.lit(values.get(k)) for k in KINDS]), kind + 1)


def linked(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """``row, found`` (weak spans with their complement in reach), for ``row, found`` of all spans."""
    spans = rows.select("row", F.inline("found")).select(
        "row", "scope", "start", "end", "kind", _named(F.col("kind"), ROLES).alias("role"),
        _named(F.col("kind"), {k: True for k in STRONG}).isNotNull().alias("strong"),
        F.floor(F.col("start") / reach).alias("bin"))
    binned = spans.groupBy("row", "scope", "bin", "role", "strong").agg(
        F.min("start").alias("low"), F.max("start").alias("high"))
    weak = spans.where(F.col("kind") >= len(BASE))
    # Each part goes to its own bin and both neighbours, each bin's row is there once for a role and strength.
    sought = weak.withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    other = binned.select("row", "scope", F.col("bin").alias("at"), F.col("role").alias("partner"),
                          F.col("strong").alias("sure"), "low", "high")
    met = sought.join(other, ["row", "scope", "at"]).where(
        (F.col("partner") != F.col("role"))
        & F.when(F.col("at") < F.col("bin"), F.col("high") >= F.col("start") - reach)
        .when(F.col("at") > F.col("bin"), F.col("low") <= F.col("start") + reach).otherwise(True))
    complete = met.groupBy("row", "scope", "start", "end", "kind").agg(
        F.bool_or("sure").alias("sure"), F.min("partner").alias("one"), F.max("partner").alias("two")).where(
        F.col("sure") | (F.col("one") != F.col("two")))
    return complete.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "scope")).alias("linked"))


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, spans`` (``start, kind, end, scope`` by start, then kind) of every row: the base and what is linked.

    ``kind`` is the place in ``KINDS``.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), whole().alias("text"))
    rows = stored(texts.mapInPandas(_found, f"id string, found {SPANS}")
                  .withColumn("row", F.monotonically_increasing_id()))  # read from files, a row keeps its number
    weak = F.exists("found", lambda x: x["kind"] >= len(BASE))
    added = linked(rows.where(weak & (F.size("found") > 1)), reach)
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    out = stored(rows.join(added, "row", "left").select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(SPANS)))).alias("spans")))
    discard(rows)
    return out


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` of every row, spans as ``kind:start:end`` by commas."""
    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", _named(x["kind"], {k: k for k in KINDS}), x["start"], x["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return secret_spans(docs, reach).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"))
