"""Folder inventories, file listings and content hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.sources import folders
from tablegate.sources.store import file_system


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_kind(name: Column) -> Column:
    """Kind by the text after the last dot."""
    ending = F.regexp_extract(name, r"([^.]*)$", 1)
    return F.when(ending.isin("maml", "parquet", "md"), ending).otherwise("extra")


def known_stem(name: Column) -> Column:
    """Name without the suffix of its kind (and nothing else removed)."""
    return F.regexp_replace(name, r"\.(maml|parquet|md)$", "")


def classify(files: DataFrame) -> DataFrame:
    """Inventory rows from ``dataset, name``: adds ``stem`` and ``kind``."""
    return files.withColumn("stem", known_stem(F.col("name"))).withColumn(
        "kind", file_kind(F.col("name")))


def _by_spark(spark: SparkSession, listed: list[str], hashed: bool) -> DataFrame:
    """A listing through the session's own file systems, for those that only Spark opens.

    Files come from the binary file source, which reads (and hashes) them in its tasks, each file as a whole.
    It leaves out subfolders, empty and hidden files: these are listed by the driver, page by page;
    a hidden file's content is not read, its hash is null.
    """
    rest, full = [], []
    for folder in listed:
        system, path = file_system(spark, folder)
        pages, some = system.listStatusIterator(path), False
        while pages.hasNext():
            status = pages.next()
            name = status.getPath().getName()
            plain = status.isFile() and status.getLen() > 0 and not name.startswith((".", "_"))
            some = some or plain
            if not plain:
                empty = status.isFile() and status.getLen() == 0
                rest.append((status.getPath().toString(), status.getLen() if status.isFile() else None,
                             status.getModificationTime(), hashlib.sha1().hexdigest() if hashed and empty else None))
        if some:
            full.append(folder)
    out = spark.createDataFrame(rest, "path string, length bigint, changed bigint, sha1 string").select(
        "path", "length", F.timestamp_millis("changed").alias("modified"), "sha1")
    if full:
        files = spark.read.format("binaryFile").load(full)
        sha1 = F.sha1("content") if hashed else F.lit(None).cast("string")
        out = files.select("path", "length", F.col("modificationTime").alias("modified"), sha1.alias("sha1")).unionByName(out)
    return out


def list_files(spark: SparkSession, listed: list[str], hashed: bool = False) -> DataFrame:
    """``path, length, modified, sha1`` of the entries of the folders, from one listing of each; subfolders
    have no length, and ``sha1`` is null unless ``hashed``."""
    if not all(folders.readable(folder) for folder in listed):
        return _by_spark(spark, listed, hashed)
    spark.dataSource.register(folders.FolderSource)
    return (spark.read.format("release_folders").option("folders", json.dumps(listed))
            .option("hashed", str(hashed).lower()).load())


def _named(files: DataFrame) -> DataFrame:
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("dataset"), "path",
        file_name(F.col("path")).alias("name"), "length", "modified", "sha1")
    return classify(named).withColumn("kind", F.when(F.col("length").isNull(), "extra").otherwise(F.col("kind")))


def inventory(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Entries of release folders: ``dataset, path, name, length, modified, stem, kind``.
    Contents are not read; subfolders have no length and count as extra files."""
    return _named(list_files(spark, folders)).drop("sha1")


def hashed_inventory(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The inventory with ``sha1`` of every file's content, from the same listing."""
    return _named(list_files(spark, folders, hashed=True))


def datasets_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``dataset`` of each release folder, also of those that hold nothing."""
    names = sorted({folder.rstrip("/").rsplit("/", 1)[-1] for folder in folders})
    return spark.createDataFrame([(name,) for name in names], "dataset string")


def sha1_checksum(content: Column) -> Column:
    return F.sha1(content)


def _stream_hashes(batches):
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "sha1": [folders.sha1_of(path) for path in batch["path"]]})


def file_hashes(files: DataFrame) -> DataFrame:
    """``path, sha1`` of listed files.  Files are dealt out by path and read in chunks,
    so neither a large folder nor a large file weighs on one task's memory."""
    return files.select("path").repartition(F.col("path")).mapInPandas(
        _stream_hashes, "path string, sha1 string")


def file_listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One row per file: ``etag, file_name, modified, directory, sha1``.  Plain storage
    has no entity tag; length and change time stand in for it."""
    files = hashed_inventory(spark, folders).where("length IS NOT NULL")
    etag = F.concat_ws("-", F.hex(F.unix_micros("modified")), F.hex("length"))
    return files.select(
        etag.alias("etag"), F.col("name").alias("file_name"),
        F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"),
        F.regexp_extract("path", r"^(.*/)[^/]*$", 1).alias("directory"), "sha1")
