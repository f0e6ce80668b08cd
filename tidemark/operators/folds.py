"""Forward-time folds, hold-outs and stratified folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DAY, ID, SEED
from tidemark.operators.ranking import ordered_position


@dataclass(frozen=True)
class Fold:
    """Rows before ``cutoff`` train the fold; rows in [cutoff, end) validate it.

    With an embargo, training rows of the last days before the cut-off are left out.
    """

    number: int
    cutoff: float
    end: float
    embargo: float = 0.0


def _span(rows: DataFrame, day: str) -> tuple[float, float]:
    low, high = rows.agg(F.min(day), F.max(day)).first()
    return float(low), float(high)


def _non_empty(rows: DataFrame, folds: list[Fold], day: str) -> list[Fold]:
    seen = []
    for f in folds:
        seen.append(F.max(in_training(f, F.col(day)).cast("int")).alias(f"t{f.number}"))
        seen.append(F.max(in_validation(f, F.col(day)).cast("int")).alias(f"v{f.number}"))
    flags = rows.agg(*seen).first()
    return [f for f in folds if flags[f"t{f.number}"] and flags[f"v{f.number}"]]


def forward_folds(rows: DataFrame, n: int = 5, min_share: float = 0.3,
                  day: str = DAY, embargo_days: float = 0.0) -> list[Fold]:
    """Rolling-forward folds; the last end is exclusive, so rows of the last day never validate.

    ``embargo_days`` leaves out training rows whose label window could reach past the cut-off
    (default none, as published).
    """
    low, high = _span(rows, day)
    cuts = [low + (high - low) * (min_share + (i + 1) * (1 - min_share) / (n + 1))
            for i in range(n + 1)]
    return _non_empty(rows, [Fold(i + 1, cuts[i], cuts[i + 1], embargo_days) for i in range(n)], day)


def cutoff_folds(rows: DataFrame, n: int = 5, min_share: float = 0.3, day: str = DAY) -> list[Fold]:
    """Rolling cut-offs whose first validation window starts at the minimum training share."""
    low, high = _span(rows, day)
    cuts = [low + (high - low) * (min_share + i / (n + 1) * (1 - min_share)) for i in range(n + 1)]
    return _non_empty(rows, [Fold(i + 1, cuts[i], cuts[i + 1]) for i in range(n)], day)


def in_training(fold: Fold, day: Column) -> Column:
    return day < fold.cutoff - fold.embargo


def in_validation(fold: Fold, day: Column) -> Column:
    return (day >= fold.cutoff) & (day < fold.end)


def validation_fold(folds: list[Fold], day: Column) -> Column:
    """Fold a row validates, NULL for none (validation windows do not overlap)."""
    expr = F.lit(None).cast("int")
    for f in reversed(folds):
        expr = F.when(in_validation(f, day), f.number).otherwise(expr)
    return expr


def first_training_fold(folds: list[Fold], day: Column) -> Column:
    """Earliest fold that trains on the row; training sets are nested, so later folds do too."""
    expr = F.lit(None).cast("int")
    for f in sorted(folds, key=lambda f: -f.cutoff):
        expr = F.when(in_training(f, day), f.number).otherwise(expr)
    return expr


def fold_roles(rows: DataFrame, folds: list[Fold], day: str = DAY) -> DataFrame:
    """One row per (row, fold) it takes part in, with its role: train or val."""
    d = F.col(day)
    options = []
    for f in folds:
        role = F.when(in_training(f, d), "train").when(in_validation(f, d), "val")
        options.append(F.when(role.isNotNull(),
                              F.struct(F.lit(f.number).alias("fold"), role.alias("role"))))
    return rows.select("*", F.inline(F.array_compact(F.array(*options))))


def holdout_role(day: Column, cutoff) -> Column:
    """Single time hold-out; rows without a date land in the validation part."""
    return F.when(day < cutoff, "train").otherwise("val")


def window_bucket(fold: Column) -> Column:
    """Selection windows: folds 1-3 stay alone, folds 4 and later share the last window."""
    return F.least(fold, F.lit(4))


def stratified_folds(rows: DataFrame, label: str, k: int = 5, seed: int = SEED,
                     row_id: str = ID) -> DataFrame:
    """Shuffled stratified folds: rows of one label are dealt out in hash order."""
    shuffled = rows.withColumn("_hash", F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(row_id))))
    placed = ordered_position(shuffled, [label], [F.col("_hash")], "_pos")
    return placed.withColumn("fold", ((F.col("_pos") - 1) % k + 1).cast("int")).drop("_hash", "_pos")
