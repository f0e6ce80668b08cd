"""Registered queries of the training-data operators, at their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, exact, hnsw, licenses, lines, negatives, packing, periods, quality, simhash, suffixes, toxicity, urls
from tidemark.llm.tables import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=1024, added=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), toxicity.grades(table(spark, sf_dir, "labels")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=13, share=20)
    return found.drop("text_key")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents"), span=suffixes.SPAN)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"), max_edits=2, min_bytes=lines.MIN_CHARACTERS, characters=True, exact=1)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.neighbours(vectors, hnsw.hundredth(vectors), k=10)


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(table(spark, sf_dir, "documents"), least=24, copies=3, rewrite=periods.planted)


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.judge(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, scale=256, positives=5, k=3, low=50, high=95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_suffixes": op8_suffixes,
    "op9_lines": op9_lines,
    "op10_neighbours": op10_neighbours,
    "op11_periods": op11_periods,
    "op12_exact": op12_exact,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {"op3_urls": urls.ORACLE, "op7_decontamination": decontam.ORACLE, "op12_exact": exact.ORACLE,
                           "op13_negatives": negatives.ORACLE}
