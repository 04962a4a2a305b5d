"""Session settings the checks rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks.  On a cluster use the session given;
    adaptive execution (on by default) sizes and splits shuffle partitions there."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tablegate")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Small distinct sets still carry heavy per-row checks: keep them spread.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
