"""Token counts through a digest cache.

1. A text's content is normalised (null as empty, outer ASCII white space cut, which the
   tokenizer drops anyhow) and digested (SHA-256); the tokenizer file and the library's
   version have a digest too.
2. Digests are joined to the stored counts of this tokenizer version.  Distinct misses,
   one text for each digest, are encoded and appended to the cache, a Parquet folder.
3. The documents' digests (no texts) are joined to the cache.

The cache is read again after the append, so a lost executor re-reads files.  Two jobs that
append the same digest do no harm: a digest is taken once on reading.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated
results from one encoding; an empty table gives an empty result; extra columns are ignored.
``cache`` may be kept between runs; without one a new folder in the shared folder is used.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.llm.bpe import encoder
from tablegate.llm.common import SPACES, shared_folder, shuffles_removed, slices, whole

LIMIT = 2048
CACHE = "digest string, version string, n_tokens long"


def version_of(path: str) -> str:
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def _counts(frames: Iterator[pd.DataFrame], path: str, version: str) -> Iterator[pd.DataFrame]:
    for frame in slices(frames, size=2 << 20):
        found = encoder(path, joined=False).ids(frame["text"].tolist())
        yield pd.DataFrame({"digest": frame["digest"].to_numpy(), "version": version,
                            "n_tokens": [len(x) // 4 for x in found]})


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return (rows.where(F.col("version") == version).groupBy("digest")
            .agg(F.max("n_tokens").alias("n_tokens")))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, digest`` of every row; ``path`` is a tokenizer file."""
    spark, version = docs.sparkSession, version_of(path)
    cache = cache or f"{shared_folder(spark)}/tablegate/counts-{uuid.uuid4().hex}"
    content = F.btrim(whole(), F.lit(SPACES))
    digested = docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"),
                           F.sha2(content, 256).alias("digest"))
    wanted = docs.select(content.alias("text")).withColumn("digest", F.sha2("text", 256))
    stored = _stored(spark, cache, version)
    if stored is not None:
        wanted = wanted.join(stored, "digest", "left_anti")
    misses = wanted.dropDuplicates(["digest"]).mapInPandas(
        partial(_counts, path=path, version=version), CACHE)
    with shuffles_removed(spark):
        misses.write.mode("append").parquet(cache)
    return digested.join(_stored(spark, cache, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
