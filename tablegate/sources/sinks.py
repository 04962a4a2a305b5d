"""Writers for skeleton and rollup documents, manifests and text tables.

Documents are written line by line from rows that carry their order, each under its own name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate import rules as R
from tablegate.sources.manifests import manifest_lines
from tablegate.sources.store import file_system


def yaml_text(value: Column) -> Column:
    """A text as a double-quoted YAML scalar (JSON strings are valid YAML)."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def yaml_number(value: Column) -> Column:
    """A number's text as YAML reads it: exponents need their sign."""
    return F.regexp_replace(value, r"[eE](\d)", "e+$1")


def skeleton_lines(fields: DataFrame, date: str) -> DataFrame:
    """Skeleton documents in long form: ``table, pos, line_no, line``.

    Required keys are left blank for the author to fill in, fields come from
    ``operators.infer.infer_fields``; a field without a range has no ``qc`` entry.
    """
    def head_value(key):
        return {
            "table": F.concat(F.lit("table: "), yaml_text(F.col("table"))),
            "date": F.lit(f'date: "{date}"'),
            "license": F.lit(f'license: "{R.DEFAULT_LICENSE}"'),
            "MAML_version": F.lit(f"MAML_version: {R.SCHEMA_VERSION}"),
            "fields": F.lit("fields:"),
        }.get(key, F.lit(f"{key}:"))

    head = F.array(F.lit("# Generated skeleton. This comment can be deleted."),
                   *[head_value(key) for key in R.DOCUMENT_REQUIRED])
    heads = fields.select("table").distinct().select(
        "table", F.lit(-1).alias("pos"), F.posexplode(head).alias("line_no", "line"))

    def blank(text):
        # The placeholder for an unknown value is written as a blank.
        return F.when(text.isin("", "--"), F.lit("")).otherwise(F.concat(F.lit(" "), yaml_text(text)))

    ranged = F.col("qc_min").isNotNull() & F.col("qc_max").isNotNull()
    entry = F.concat(
        F.array(
            F.concat(F.lit("- name: "), yaml_text(F.col("name"))),
            F.concat(F.lit("  unit:"), blank(F.col("unit"))),
            F.concat(F.lit("  info:"), blank(F.col("info"))),
            F.concat(F.lit("  ucd:"), blank(F.col("ucd"))),
            F.concat(F.lit("  data_type: "), F.col("data_type"))),
        F.when(ranged, F.array(
            F.lit("  qc:"),
            F.concat(F.lit("    min: "), yaml_number(F.col("qc_min"))),
            F.concat(F.lit("    max: "), yaml_number(F.col("qc_max"))))
        ).otherwise(F.array().cast("array<string>")))
    entries = fields.filter("supported").select(
        "table", "pos", F.posexplode(entry).alias("line_no", "line"))
    return heads.unionByName(entries)


def rollup_lines(rollup: DataFrame) -> DataFrame:
    """Rollup documents as text rows ``dataset, section, order_file, order_pos, line_no,
    line`` from ``operators.rollup.build_rollup``."""
    key, value = F.col("key"), F.col("value")
    scalar = F.when(key == "version", F.concat(key, F.lit(": "), value)).otherwise(
        F.concat(key, F.lit(":"), F.coalesce(F.concat(F.lit(" "), yaml_text(value)), F.lit(""))))
    line = (F.when(key == "coauthors", F.array(F.concat(F.lit("- "), yaml_text(value))))
            .when(key == "tables", F.array(
                F.concat(F.lit("- name: "), yaml_text(value)),
                F.concat(F.lit("  version: "), F.col("version"))))
            .otherwise(F.array(scalar)))
    items = rollup.select("dataset", "section", "order_file", "order_pos",
                          F.posexplode(line).alias("line_no", "line"))
    lists = rollup.filter(key.isin("coauthors", "tables")).select(
        "dataset", "section", "key").distinct()
    titles = lists.select(
        "dataset", "section", F.lit("").alias("order_file"), F.lit(-1).alias("order_pos"),
        F.lit(0).alias("line_no"), F.concat("key", F.lit(":")).alias("line"))
    return items.unionByName(titles)


def _part_of(system, folder) -> str:
    """The one part file of a folder."""
    pages, parts = system.listStatusIterator(folder), []
    while pages.hasNext():
        path = pages.next().getPath()
        if path.getName().startswith("part-"):
            parts.append(path)
    if len(parts) != 1:
        raise RuntimeError(f"{folder.toString()} holds {len(parts)} part files, not one")
    return parts[0]


def write_named(lines: DataFrame, key: str, order: list[str], root: str, name: Callable[[str], str]) -> None:
    """Write each key's text rows, in order, as one file: ``<root>/<name(key)>``.

    The rows of a key are sorted and written by one task, which spills and streams, so that a file may be of
    any length.  Files are written beside their places first and renamed when all of them are whole:
    readers see an old file or a new one, and a task that was tried again leaves nothing behind.
    """
    spark = lines.sparkSession
    work = f"{root.rstrip('/')}/_{uuid.uuid4().hex}"
    system, folder = file_system(spark, work)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    rename = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    try:
        (lines.repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, "line")
         .write.partitionBy(key).text(work))
        context = hadoop.FileContext.getFileContext(folder.toUri(), conf)
        keys = system.listStatusIterator(folder)
        while keys.hasNext():
            of_key = keys.next().getPath()
            _, found, escaped = of_key.getName().partition("=")
            value = unquote(escaped)
            if not found:
                continue  # the mark of a whole write
            if escaped == "__HIVE_DEFAULT_PARTITION__" or "/" in value:
                raise ValueError(f"no file can be named after {key} {value!r}")
            part = _part_of(system, of_key)
            # A local file system keeps checksums beside its files; they are not part of a release.
            if is_instance_of(spark.sparkContext._gateway, system, "org.apache.hadoop.fs.ChecksumFileSystem"):
                system.getRawFileSystem().delete(hadoop.Path(of_key, f".{part.getName()}.crc"), False)
            target = hadoop.Path(f"{root.rstrip('/')}/{name(value)}")
            system.mkdirs(target.getParent())
            context.rename(part, target, rename)
    finally:
        system.delete(folder, True)


def write_skeletons(fields: DataFrame, date: str, path: str) -> None:
    """``<path>/<table>.maml`` for every table."""
    write_named(skeleton_lines(fields, date), "table", ["pos", "line_no"], path, lambda table: f"{table}.maml")


def write_rollups(rollup: DataFrame, path: str) -> None:
    """``<path>/<dataset>/<dataset>.daml`` for every dataset."""
    write_named(rollup_lines(rollup), "dataset", ["section", "order_file", "order_pos", "line_no"], path,
                lambda dataset: f"{dataset}/{dataset}.daml")


def write_manifest_lines(lines: DataFrame, path: str) -> None:
    """``<path>/<dataset>/<dataset>.checksums`` for every dataset of ``manifests.manifest_lines``."""
    write_named(lines, "dataset", ["line_group", "name"], path, lambda dataset: f"{dataset}/{dataset}.checksums")


def write_manifests(files: DataFrame, path: str) -> None:
    """The same for every dataset of ``dataset, name, sha1``."""
    write_manifest_lines(manifest_lines(files), path)


def text_table(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows rendered at fixed width: ``part`` (0 header, 1 rule, 2 row), the order
    columns, ``line``.  Every column is as wide as its longest value or its name.

    The widths are one row from one aggregate over the table; they reach the rows as
    a scalar subquery's struct.
    """
    names = df.columns
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in names}
    widths = df.agg(*[
        F.greatest(F.coalesce(F.max(F.length(text[c])), F.lit(0)), F.lit(len(c))).alias(c)
        for c in names])
    width = widths.select(F.struct(*names)).scalar()

    def cell(value, c):
        return F.rpad(value, width[c], F.lit(" "))

    def blank():
        return [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]

    rows = df.select(F.lit(2).alias("part"), *order,
                     F.concat_ws(" | ", *[cell(text[c], c) for c in names]).alias("line"))
    head = widths.select(F.lit(0).alias("part"), *blank(), F.concat_ws(
        " | ", *[F.rpad(F.lit(c), F.col(c), F.lit(" ")) for c in names]).alias("line"))
    rule = widths.select(F.lit(1).alias("part"), *blank(), F.concat_ws(
        "-+-", *[F.repeat(F.lit("-"), F.col(c)) for c in names]).alias("line"))
    return head.unionByName(rule).unionByName(rows)
