"""The registered queries of this subpackage on the given tables, with SQL where it can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegate.llm import (classifier, decontaminate, license_scan, line_dedup, packing, periodic_runs, quality_rules,
                           ranked_search, secret_scan, simhash, substring_dedup, suffix_dedup, token_counts)
from tablegate.llm.common import let, whole

#: The vocabulary files of public tokenizers; workers open them at the same path.
TOKENIZERS = public_tokenizers.path("byte_bpe_50k.json").rsplit("/", 1)[0]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf, "documents"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(table(spark, sf, "documents"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.judged(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("tag")


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf, "documents")).drop("clean_text")


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), f"{TOKENIZERS}/word_bpe_49k.json").drop("digest")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = classifier.train(docs, table(spark, sf, "labels"))
    return classifier.scored(docs, model).drop("tag")


def planted(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, told by their ids, get a periodic tail; the others stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(F.struct((g % n).alias("a"), n.alias("n")), lambda s: let(
            F.lit(1) + F.floor((s["n"] - s["a"]) / (3 + g % 8)),
            lambda p: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(
                F.get(words, (s["a"] + (i - s["a"]) % p).cast("int")))), " ")))

    words = quality_rules.words_of(text)
    return F.when((h % 10 == 0) & (text.rlike(r"[^\x20\x09-\x0D]")), let(words, tail)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = periodic_runs.periodic_runs(docs.select("doc_id", planted(whole(), F.col("doc_id")).alias("text")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_license_scan, op3_line_dedup, op4_simhash, op5_decontaminate, op6_quality_rules,
    op7_token_counts, op8_packing, op9_substring_dedup, op10_quality_classifier, op11_periodic_runs,
    op12_ranked_search, op13_secret_scan)}
ORACLES = {"op3_line_dedup": line_dedup.SQL, "op6_quality_rules": quality_rules.SQL,
           "op12_ranked_search": ranked_search.SQL}
