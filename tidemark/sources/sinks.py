"""Score files, caches and ledgers in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import BINARY, CATEGORICAL, DATE, GROUP, ID, LABELS, PERSON, SCORES, TOPICS, TRAINER
from tidemark.functions import fields
from tidemark.functions.probability import clip, ordered
from tidemark.sources.workspace import exists

# Column names of a score file.
AUC_COLUMN = "Target_{}_AUC"
LOSS_COLUMN = "Target_{}_LogLoss"


def submission(scores: DataFrame, ranked: DataFrame | None = None, row_id: str = ID) -> DataFrame:
    """ID and two columns per horizon; AUC columns may come from a second score set.

    The second set must score the same rows; any row without a partner is refused with the counts.
    """
    x = scores
    if ranked is not None:
        counts = match_counts(scores, ranked, row_id).first()
        if counts["left_only"] or counts["right_only"]:
            raise ValueError(f"score sets differ: {counts.asDict()}")
        x = x.join(ranked.select(row_id, *[F.col(p).alias(f"rank_{p}") for p in SCORES.values()]),
                   row_id)
    columns = [F.col(row_id).alias("ID")]
    for h, p in SCORES.items():
        ranking = F.col(f"rank_{p}") if ranked is not None else F.col(p)
        columns += [clip(ranking).alias(AUC_COLUMN.format(h)),
                    clip(F.col(p)).alias(LOSS_COLUMN.format(h))]
    return x.select(*columns)


def match_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of both tables, of the left one only, of the right one only."""
    sides = (left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
             .groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")))
    return sides.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched"),
                     F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"))


def oof_submission(oof: DataFrame, row_id: str = ID) -> DataFrame:
    """Score file of the covered training rows, horizons ordered."""
    fixed = ordered(*[clip(F.col(p)) for p in SCORES.values()])
    return submission(oof.withColumns(dict(zip(SCORES.values(), fixed))), row_id=row_id)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("error").csv(path, header=True)


def submission_schema() -> T.StructType:
    names = [n for h in SCORES for n in (AUC_COLUMN.format(h), LOSS_COLUMN.format(h))]
    return T.StructType([T.StructField("ID", T.LongType())]
                        + [T.StructField(n, T.DoubleType()) for n in names])


def read_submissions(spark: SparkSession, pattern: str) -> DataFrame:
    """Every score file under a glob, with the folder each row came from."""
    rows = spark.read.schema(submission_schema()).csv(pattern, header=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.select("*", F.element_at(parts, -2).alias("run"))


def raw_log_schema(has_targets: bool = True) -> T.StructType:
    """Text schema of a raw training log; explicit, never inferred."""
    names = [ID, PERSON, DATE, TRAINER, TOPICS, GROUP, *CATEGORICAL, *BINARY]
    return T.StructType([T.StructField(n, T.StringType()) for n in names]
                        + [T.StructField(n, T.StringType())
                           for n in (LABELS.values() if has_targets else [])])


def read_raw_log(spark: SparkSession, path: str, has_targets: bool = True) -> DataFrame:
    """CSV scan and normalisation of every contract column in one projection.

    Flags and targets may be 0/1 or true/false in any case; anything else is NULL.
    """
    raw = spark.read.schema(raw_log_schema(has_targets)).csv(path, header=True, escape='"')
    flags = [fields.flag(F.col(c)).alias(c) for c in [*BINARY, *(LABELS.values() if has_targets else [])]]
    date = fields.parse_date(F.col(DATE))
    return raw.select(F.col(ID).try_cast("long").alias(ID), PERSON, date.alias(DATE),
                      F.unix_date(date).alias("day"), fields.trainer_name(F.col(TRAINER)).alias(TRAINER),
                      fields.topic_array(F.col(TOPICS)).alias(TOPICS), GROUP, *CATEGORICAL, *flags)


class ScoreCache:
    """Score tables kept under a version; a read with a wrong row count is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, scores: DataFrame, version: str) -> None:
        scores.write.mode("error").parquet(f"{self.path}/artifact_version={version}")

    def load(self, version: str, expected_rows: int | None = None) -> DataFrame | None:
        """The cached table, or None when it is missing or holds another number of rows."""
        place = f"{self.path}/artifact_version={version}"
        if not exists(self.spark, place):
            return None
        cached = self.spark.read.parquet(place)
        if expected_rows is not None and cached.count() != expected_rows:
            return None
        return cached


def write_ledger(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("error").json(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
