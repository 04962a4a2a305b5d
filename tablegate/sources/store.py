"""Intermediate tables: rows written once as Parquet in the shared folder, and read from there.

For results that several later steps read, where computing them again would cost more than writing
them.  A lost executor then costs the tasks that read the table, nothing before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local session that names none, as in tests, gets a temporary folder; a cluster's is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("intermediate tables need a shared folder: set spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablegate-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/tablegate/{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go as soon as its result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_folder(spark)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A join's side that grows with the tables or datasets: it is shuffled and never gathered on the driver.

    Spark broadcasts what is below its limit, and a plan of many joins gathers many such sides at once.
    """
    return df.hint("merge")


def plain_path(encoded: Column) -> Column:
    """A path as files are named, from the URI spelling of ``_metadata``."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def file_system(spark: SparkSession, path: str):
    """The session's Hadoop file system of a path (a Java object), and the path as one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    system, folder = file_system(spark, path)
    system.delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            remove(df.sparkSession, path)
