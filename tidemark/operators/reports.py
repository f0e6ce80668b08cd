"""Table profiles, class balance and id overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_count_and_duplicates(rows: DataFrame) -> DataFrame:
    """Rows, and rows that repeat an earlier row in every column."""
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    return distinct.agg(F.sum("_n").alias("n_rows"),
                        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"))


def column_profile(rows: DataFrame) -> DataFrame:
    """Per column: type, missing count and share, distinct values; one scan for all columns.

    Distinct values come from one (column, value) aggregation that combines on the map side.
    """
    kinds = dict(rows.dtypes)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"),
                      F.col(c).cast("string").alias("value")) for c, t in kinds.items()]
    counts = (rows.select(F.inline(F.array(*cells)))
              .groupBy("column_name", "column_type", "value").agg(F.count(F.lit(1)).alias("n")))
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return counts.groupBy("column_name", "column_type").agg(
        missing.alias("missing"), (missing / F.sum("n") * 100).alias("missing_pct"),
        F.count("value").alias("n_unique"))


def describe_numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, from one aggregate row."""
    wide = rows.agg(*[e for c in columns for e in (
        F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"),
        F.stddev_samp(c).alias(f"{c}_std"), F.min(F.col(c).cast("double")).alias(f"{c}_min"),
        F.max(F.col(c).cast("double")).alias(f"{c}_max"))])
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("n"),
                      F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"),
                      F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"))
             for c in columns]
    return wide.select(F.inline(F.array(*parts)))


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their share (a top-k report)."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(
        F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.select(F.count(F.lit(1))).scalar()
    return (counts.orderBy(F.col("n").desc(), "value").limit(k)
            .select("value", "n", (F.col("n") / total * 100).alias("pct")))


def class_balance(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows and share per label value, and the rarest to commonest class ratio."""
    pairs = [F.struct(F.lit(y).alias("target"), F.col(y).alias("value")) for y in labels]
    counts = (rows.select(F.inline(F.array(*pairs))).groupBy("target", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    of = Window.partitionBy("target")  # two rows per label
    return counts.select("target", "value", "n",
                         (F.col("n") / F.sum("n").over(of) * 100).alias("pct"),
                         (F.min("n").over(of) / F.max("n").over(of)).alias("imbalance"))


def date_profile(rows: DataFrame, column: str) -> DataFrame:
    days = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return days.agg(F.min(column).alias("first"), F.max(column).alias("last"),
                    F.count(column).alias("n_unique"),
                    F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("_n"))), F.lit(0))
                    .alias("missing"))


def id_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids of both tables, of each table alone, and shared."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"),
                    F.count(F.col("_a") + F.col("_b")).alias("n_shared"))
