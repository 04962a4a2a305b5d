"""Training-text pipeline: quality, shared lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.llm import classifier, common, decontaminate, line_dedup, packing, simhash
from tablegate.llm.queries import TOKENIZERS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites in different texts go; ``n_chars`` follows the text.

    Exact copies count once here: the next stage keeps one document of them.
    """
    out = line_dedup.line_dedup(docs, distinct_texts=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id."""
    return simhash.simhash_dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences."""
    return packing.best_fit_packing(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies),
          ("benchmark decontamination", leaks), ("best-fit packing", packed)]
#: Trees, fingerprints and token ids cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/tablegate/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with common.shuffles_removed(spark):
            out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
