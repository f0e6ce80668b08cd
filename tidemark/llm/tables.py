"""Written intermediate tables in the shared folder, and small helpers on document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.workspace import fresh_path

_paths: dict[int, tuple[DataFrame, str]] = {}


def write(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and return a reader of the written files."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``write`` that nothing reads any more."""
    _, path = _paths.pop(id(df))
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two(columns: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, so that further columns, whatever their names, cannot clash."""
    return columns.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                          F.col(f"`{text}`").cast("string").alias("text"))


def content_key():
    """Identity of a row for joins back: equal texts have equal results, so they may share it."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def held_out():
    """The contract's held-out rows: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
