"""Checksum manifests and stored hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.functions.findings import explode_once
from tablegate.sources.store import plain_path

_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def parse_manifest(lines: DataFrame, keys: list[str], drop_empty: bool = True) -> DataFrame:
    """Entries of manifests given as lines ``<keys>, line_no, line``: ``<keys>, name, sha1``.

    Blank lines, ``#`` comments and lines without a colon are skipped; a line splits
    at its first colon; of a repeated name the last line holds.  ``drop_empty`` also
    skips entries whose name or hash is empty.
    """
    text = strip(F.col("line"))
    entry = lines.filter(F.contains("line", F.lit(":"))).select(*keys, "line_no", text.alias("line"))
    entry = entry.filter(~F.startswith("line", F.lit("#")))
    split_at = F.instr("line", ":")
    named = entry.select(
        *keys, "line_no",
        strip(F.substring("line", F.lit(1), split_at - 1)).alias("name"),
        strip(F.substring("line", split_at + 1, F.length("line"))).alias("sha1"))
    if drop_empty:
        named = named.filter((F.col("name") != "") & (F.col("sha1") != ""))
    return named.groupBy(*keys, "name").agg(F.max_by("sha1", "line_no").alias("sha1"))


def text_lines(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Lines of whole texts with their 0-based number."""
    body = F.regexp_replace(text, "\r\n?", "\n")
    return explode_once(texts, keys, F.split(body, "\n"), "line_no", "line")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Entries of manifest files: ``dataset, name, sha1``; the dataset is the file's stem."""
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(plain_path(F.col("_metadata.file_name")), r"^(.*?)(\.checksums)?$", 1).alias("dataset"),
        F.col("value").alias("text"))
    return parse_manifest(text_lines(whole, ["dataset"], "text"), ["dataset"])


def stored_hash(text: Column, algorithm: str = "SHA1") -> Column:
    """One algorithm's digest out of ``ALGO:hex ALGO:hex ...``; null when absent."""
    parts = F.filter(F.split(text, " "), lambda p: F.split_part(p, F.lit(":"), F.lit(1)) == algorithm)
    return F.split_part(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit(":"), F.lit(2))


def manifest_lines(files: DataFrame) -> DataFrame:
    """Manifest text rows ``dataset, line_group, name, line`` for ``dataset, name, sha1``:
    three header comments, then one line per file except the manifest itself."""
    header = F.array(
        F.lit("# Generated after a successful release check."),
        F.lit("# Do not edit by hand."),
        F.concat(F.lit("# Upload together with the files of "), F.col("dataset"), F.lit(".")))
    heads = files.select("dataset").distinct().select(
        "dataset", F.posexplode(header).alias("line_group", "line"))
    entries = files.filter(F.col("name") != F.concat("dataset", F.lit(".checksums"))).select(
        "dataset", F.lit(3).alias("line_group"), "name",
        F.concat("name", F.lit(": "), "sha1").alias("line"))
    return heads.withColumn("name", F.lit("")).unionByName(entries)
