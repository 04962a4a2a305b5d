"""Metadata documents: YAML text in, JSON text out.

Spark has no YAML reader; this is the one place where Python runs per row.  Texts
arrive in Arrow batches and leave as JSON, everything after is native.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.functions.kinds import NON_FINITE
from tablegate.functions.lint import SUSPECT, first_offence, lint_findings, offence_message
from tablegate.sources.store import plain_path


#: Texts whose tag a task keeps; a bound on its memory only, any other text is matched anew.
KNOWN_TEXTS, KNOWN_LENGTH = 10_000, 64


def _loader():
    """The safe YAML loader without implicit dates, which stay text."""
    import yaml

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    loader = type("TextDateLoader", (base,), {})
    loader.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in resolvers if tag != "tag:yaml.org,2002:timestamp"]
        for first, resolvers in base.yaml_implicit_resolvers.items()}

    plain, of_sequence = yaml.nodes.ScalarNode, base.resolve
    known: dict[str, str] = {}

    def resolve(self, kind, value, implicit):
        """A plain scalar's tag, by its text: keys and common values are matched with the patterns once."""
        if kind is not plain or not implicit[0] or len(value) > KNOWN_LENGTH:
            return of_sequence(self, kind, value, implicit)
        tag = known.get(value)
        if tag is None:
            tag = of_sequence(self, kind, value, implicit)
            if len(known) < KNOWN_TEXTS:
                known[value] = tag
        return tag

    loader.resolve = resolve
    return yaml, loader


def _plain(node):
    """Replace what JSON cannot hold: non-text keys, odd types, NaN and infinities (marked texts; a text
    that begins with the mark gets a second one)."""
    if type(node) is str and not node.startswith(NON_FINITE):
        return node
    if isinstance(node, dict):
        return {key if isinstance(key, str) else str(key): _plain(item) for key, item in node.items()}
    if isinstance(node, (list, tuple, set)):
        return [_plain(item) for item in node]
    if isinstance(node, float) and not math.isfinite(node):
        return NON_FINITE + ("NaN" if math.isnan(node) else "Infinity" if node > 0 else "-Infinity")
    if node is None or isinstance(node, (bool, int, float)):
        return node
    text = str(node)
    return NON_FINITE + text if text.startswith(NON_FINITE) else text


def _convert(batches):
    yaml, loader = _loader()

    def convert(text):
        try:  # whatever one document does to the parser, its row says so and the others go on
            loaded = yaml.load(text, Loader=loader)
            if not isinstance(loaded, dict):
                return None, "expected a mapping at the top level"
            raw = json.dumps(_plain(loaded), ensure_ascii=False)
            raw.encode()
            return raw, None
        except Exception as error:  # noqa: BLE001
            return None, " ".join(f"{type(error).__name__} {error}".split())

    for batch in batches:
        converted = [convert(text) if offence is None else (None, offence)
                     for text, offence in zip(batch["text"], batch["offence"])]
        yield pd.DataFrame({
            "file": batch["file"],
            "raw": [raw for raw, _ in converted],
            "parse_error": [error for _, error in converted]})


def parse_documents(texts: DataFrame) -> DataFrame:
    """``file, text`` to ``file, raw, parse_error``; unreadable documents keep their row.  With a column
    ``offence``, a text that has one is not parsed and this is its error."""
    offence = F.col("offence") if "offence" in texts.columns else F.lit(None).cast("string")
    return texts.select("file", "text", offence.alias("offence")).mapInPandas(
        _convert, "file string, raw string, parse_error string")


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(plain_path(F.col("_metadata.file_path")).alias("file"),
                        F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, raw, parse_error`` of the documents under a path or several.  A document with a spacing
    offence is rejected like one that cannot be parsed."""
    return reject_offences(read_texts(spark, path))


def reject_offences(texts: DataFrame) -> DataFrame:
    """Parsed documents; those the lint objects to have its first message and no content.  One pass: the
    lint is an expression of the row that is then parsed."""
    offence = F.when(F.col("text").rlike(SUSPECT), offence_message(first_offence(F.col("text"))))
    return parse_documents(texts.select("file", "text", offence.alias("offence")))


def lint_documents(texts: DataFrame) -> DataFrame:
    """Spacing findings of the raw texts: ``file, check, severity, message``."""
    return lint_findings(texts, ["file"], "text")
