"""History profiles: per person, and per trainer, group and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import (DAY, LABELS, MIN_SUPPORT, PERSON, PROFILE_KEYS, TOPICS,
                             UNSEEN_RATE)
from tidemark.functions.probability import confidence
from tidemark.operators.folds import Fold, first_training_fold
from tidemark.sources.workspace import Parts, part

EVERY = "__all__"


def person_profile(history: DataFrame) -> DataFrame:
    """Label rates, visits, distinct topics, day span and cooperative rate per person."""
    known = history.where(F.col(PERSON).isNotNull())
    visits = known.groupBy(PERSON).agg(
        *[F.avg(y).alias(f"prior_{y}_rate") for y in LABELS.values()],
        F.count(F.lit(1)).alias("prior_training_count"),
        (F.max(DAY) - F.min(DAY)).alias("prior_span_days"),
        F.avg("belong_to_cooperative").alias("prior_coop_rate"))
    topics = (known.select(PERSON, F.explode(TOPICS).alias("topic")).distinct()
              .groupBy(PERSON).agg(F.count(F.lit(1)).alias("prior_topic_diversity")))
    return visits.join(topics, PERSON, "left").withColumn(
        "prior_topic_diversity", F.coalesce("prior_topic_diversity", F.lit(0)))


def key_counts(rows: DataFrame, keys: list[str], folds: list[Fold] | None = None) -> DataFrame:
    """Rows and label hits per (key name, key value), and per fold when folds are given.

    All keys are counted in one scan and one shuffle. Training sets of forward folds are nested,
    so each row is counted once, in the first fold that trains on it, and the per-fold counts are
    summed up afterwards from these few aggregated rows. The reserved key name ``__all__`` holds
    the totals. Rows with a NULL key are left out of that key.
    """
    hits = [F.sum(y).alias(f"s{h}") for h, y in LABELS.items()]
    pairs = [F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value"))
             for k in keys]
    pairs.append(F.struct(F.lit(EVERY).alias("key_name"), F.lit(EVERY).alias("key_value")))
    part = F.lit(0) if folds is None else first_training_fold(folds, F.col(DAY))
    flat = rows.select(part.alias("fold"), F.inline(F.array(*pairs)), *LABELS.values())
    flat = flat.where(F.col("key_value").isNotNull() & F.col("fold").isNotNull())
    counts = flat.groupBy("key_name", "key_value", "fold").agg(F.count(F.lit(1)).alias("n"), *hits)
    if folds is None:
        return counts.drop("fold")
    later = F.array(*[F.lit(f.number) for f in folds])
    spread = counts.withColumn("first", F.col("fold")).withColumn(
        "fold", F.explode(F.filter(later, lambda f: f >= F.col("first"))))
    return spread.groupBy("fold", "key_name", "key_value").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{h}").alias(f"s{h}") for h in LABELS])


def overall_rates(counts: DataFrame) -> DataFrame:
    """Label rates over all rows (per fold if counted so): one row, or one row per fold."""
    keys = ["fold"] if "fold" in counts.columns else []
    return counts.where(F.col("key_name") == EVERY).select(
        *keys, *[(F.col(f"s{h}") / F.col("n")).alias(f"g{h}") for h in LABELS])


def with_overall(counts: DataFrame) -> DataFrame:
    """Counts of the named keys beside the overall rates (at most one row per fold)."""
    named = counts.where(F.col("key_name") != EVERY)
    rates = overall_rates(counts)
    if "fold" in counts.columns:
        return named.join(F.broadcast(rates), "fold")
    return named.withColumns({f"g{h}": rates.select(f"g{h}").scalar() for h in LABELS})


def _plain() -> list[Column]:
    return [(F.col(f"s{h}") / F.col("n")).alias(f"{y}_rate") for h, y in LABELS.items()]


def _confident(min_support: int) -> list[Column]:
    cols: list[Column] = []
    for h, y in LABELS.items():
        rate, error, low = confidence(F.col(f"s{h}"), F.col("n"), F.col(f"g{h}"), min_support)
        cols += [rate.alias(f"{y}_rate_smoothed"), error.alias(f"{y}_rate_se"),
                 low.alias(f"{y}_rate_lower95")]
    return cols


def key_profile(counts: DataFrame) -> DataFrame:
    """Plain label rates and row count per key value."""
    return counts.where(F.col("key_name") != EVERY).select(
        "key_name", "key_value", F.col("n").alias("count"), *_plain())


def confidence_profile(counts: DataFrame, min_support: int = 0) -> DataFrame:
    """Smoothed label rate, standard error and lower bound per key value."""
    keys = ["fold"] if "fold" in counts.columns else []
    return with_overall(counts).select(*keys, "key_name", "key_value",
                                       F.col("n").alias("count"), *_confident(min_support))


def full_profile(counts: DataFrame) -> DataFrame:
    """Plain and smoothed rates side by side, so that both blocks need one join per key."""
    return with_overall(counts).select("key_name", "key_value", F.col("n").alias("count"),
                                       *_plain(), *_confident(0))


def blocks_of(column: str) -> tuple[str, ...]:
    """Feature blocks of a profile column: counts serve both the plain and the confidence block."""
    return {"rate": ("aggregates",), "count": ("aggregates", "confidence")}.get(column.rsplit("_", 1)[-1], ("confidence",))


def target_encoding(counts: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """As-of encodings: confidence profile with a support floor."""
    return confidence_profile(counts, min_support)


def earlier_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and label hits of each key value on all days *before* a day on which it occurs, with the overall rates before it.

    Rows shrink to one per (key, value, day) before the windows, which then hold at most one row per calendar day,
    however hot a value is. Days on which nothing of the key value is known yet are left out.
    """
    pairs = [F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value")) for k in keys]
    pairs.append(F.struct(F.lit(EVERY).alias("key_name"), F.lit(EVERY).alias("key_value")))
    flat = rows.where(F.col(DAY).isNotNull()).select(DAY, F.inline(F.array(*pairs)), *LABELS.values())
    daily = flat.where(F.col("key_value").isNotNull()).groupBy("key_name", "key_value", DAY).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(f"s{h}") for h, y in LABELS.items()])
    before = (Window.partitionBy("key_name", "key_value").orderBy(DAY)
              .rowsBetween(Window.unboundedPreceding, -1))
    known = daily.select("key_name", "key_value", DAY, *[F.sum(c).over(before).alias(c) for c in
                                                         ("n", *[f"s{h}" for h in LABELS])]).where("n > 0")
    overall = known.where(F.col("key_name") == EVERY).select(
        DAY, *[(F.col(f"s{h}") / F.col("n")).alias(f"g{h}") for h in LABELS])
    return known.where(F.col("key_name") != EVERY).join(overall, DAY)


def daily_encoding(rows: DataFrame, keys: list[str], min_support: int = MIN_SUPPORT) -> DataFrame:
    """Encodings per key value and day from earlier days only, so that no row's own label is in them."""
    return earlier_counts(rows, keys).select(DAY, "key_name", "key_value", F.col("n").alias("count"),
                                             *_confident(min_support))


def attach_profile(rows: DataFrame, profile: DataFrame | Parts, key: str, prefix: str,
                   fill: float | None = None) -> DataFrame:
    """Left-join the profile columns of one key, named ``<prefix>_<column>``."""
    names = [c for c in profile.columns if c not in ("key_name", "key_value", "fold", DAY)]
    keys = [c for c in ("fold", DAY) if c in profile.columns and c in rows.columns]
    side = part(profile, "key_name", key).select(
        *keys, F.col("key_value").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in names])
    out = rows.join(side, [*keys, key], "left")
    if fill is None:
        return out
    return out.withColumns({f"{prefix}_{c}": F.coalesce(f"{prefix}_{c}", F.lit(fill))
                            for c in names})


def attach_all(rows: DataFrame, profile: DataFrame | Parts) -> DataFrame:
    for key, prefix in PROFILE_KEYS.items():
        rows = attach_profile(rows, profile, key, prefix)
    return rows


def attach_encodings(rows: DataFrame, encodings: DataFrame, keys: list[str]) -> DataFrame:
    """Encoded columns per key; unseen keys get 0.5 in every column, the count included."""
    for key in keys:
        rows = attach_profile(rows, encodings, key, f"te_{key}", UNSEEN_RATE)
    return rows


def known_person(rows: DataFrame, history: DataFrame, name: str = "has_prior_history") -> DataFrame:
    """1 when the person occurs in the history."""
    seen = (history.select(PERSON).where(F.col(PERSON).isNotNull()).distinct()
            .withColumn(name, F.lit(1)))
    return rows.join(seen, PERSON, "left").withColumn(name, F.coalesce(name, F.lit(0)))
