"""A corpus pipeline over ``documents``: each stage's output is written and read again by the next.

Stages keep the columns of their input, whatever they are; the last one returns pieces of packed
sequences. A stage that shortens texts brings ``n_chars`` up to date. Nulls, empty texts, repeated
rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, packing, quality, simhash
from tidemark.llm.tables import table, write


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier document, or the same one, has up to two edits of characters; short lines by equality."""
    out = lines.deduplicate(docs, max_edits=2, min_bytes=lines.MIN_CHARACTERS, characters=True, exact=1)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.keep_first(docs, shingle=3, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of a benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), span=13, share=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack(docs, length=1024, added=True)


STAGES = [("quality", keep_good), ("line_dedup", cut_lines), ("near_dedup", drop_copies), ("decontamination", drop_contaminated),
          ("packing", pack)]
#: Fitted scores, components and token ids have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
