"""Deterministic score sets: smoothed as-of label rates of one key, out of fold.

They need no model fit, so metrics, blends and gates can be checked exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DAY, GROUP, ID, LABELS, SCORES, TRAINER
from tidemark.functions.probability import clip, ordered, smoothed
from tidemark.operators.folds import Fold, forward_folds, validation_fold
from tidemark.operators.profiles import EVERY, key_counts, with_overall
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog

RATE_MODELS = {"ward_rate": "ward", "group_rate": GROUP, "trainer_rate": TRAINER}
SCORE_DIGITS = 6


def log_folds(log: TrainingLog) -> list[Fold]:
    return forward_folds(log.train)


def rate_scores(train: DataFrame, folds: list[Fold],
                models: dict[str, str] = RATE_MODELS) -> DataFrame:
    """Out-of-fold scores (model, row, fold, p07, p90, p120, labels): per fold, the smoothed rate
    of the row's key over the fold's training rows; unseen keys get the overall rate."""
    counts = workspace.materialise(key_counts(train, list(models.values()), folds), "foldcounts")
    rates = with_overall(counts).select("fold", "key_name", "key_value", *[
        smoothed(F.col(f"s{h}"), F.col("n"), F.col(f"g{h}")).alias(f"r{h}") for h in LABELS])
    rates = workspace.materialise(rates, "foldrates")
    overall = counts.where(F.col("key_name") == EVERY).select(
        "fold", *[(F.col(f"s{h}") / F.col("n")).alias(f"g{h}") for h in LABELS])
    named = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("key_name"),
                      F.col(k).cast("string").alias("key_value")) for m, k in models.items()]
    rows = (train.withColumn("fold", validation_fold(folds, F.col(DAY)))
            .where(F.col("fold").isNotNull())
            .select(ID, "fold", *LABELS.values(), F.inline(F.array(*named))))
    # The overall side holds one row per fold.
    scored = (rows.join(rates, ["fold", "key_name", "key_value"], "left")
              .join(F.broadcast(overall), "fold"))
    raw = [clip(F.round(F.coalesce(f"r{h}", f"g{h}"), SCORE_DIGITS)) for h in LABELS]
    final = [e.alias(p) for e, p in zip(ordered(*raw), SCORES.values())]
    return scored.select("model", ID, "fold", *final, *LABELS.values())


def rate_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate scores of a table folder, written once per application."""
    log = TrainingLog(spark, sf_dir)
    return workspace.shared(spark, f"rate_oof:{sf_dir}",
                            lambda: rate_scores(log.train, log_folds(log)))
