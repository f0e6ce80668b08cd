"""Probability columns: bounds, ordering, hazards and smoothed rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CLIP_HIGH, CLIP_LOW, PRIOR_STRENGTH, Z95


def clip(p: Column, low: float = CLIP_LOW, high: float = CLIP_HIGH) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def ordered(p07: Column, p90: Column, p120: Column) -> tuple[Column, Column, Column]:
    """Lower the shorter horizons so that p07 <= p90 <= p120."""
    mid = F.least(p90, p120)
    return F.least(p07, mid), mid, p120


def intervals(y07: Column, y90: Column, y120: Column) -> tuple[Column, Column, Column]:
    """Nested labels to disjoint intervals (0,7], (7,90], (90,120]."""
    return ((y07 == 1).cast("int"), ((y90 == 1) & (y07 == 0)).cast("int"),
            ((y120 == 1) & (y90 == 0)).cast("int"))


def cumulative(h1: Column, h2: Column, h3: Column) -> tuple[Column, Column, Column]:
    """Interval hazards to cumulative probabilities."""
    keep1 = 1 - h1
    keep2 = keep1 * (1 - h2)
    return 1 - keep1, 1 - keep2, 1 - keep2 * (1 - h3)


def log_loss_term(p: Column, y: Column) -> Column:
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def smoothed(hits: Column, n: Column, overall: Column,
             strength: float = PRIOR_STRENGTH) -> Column:
    """Posterior mean under a Beta prior centred on the overall rate."""
    return (hits + strength * overall) / (n + strength)


def confidence(hits: Column, n: Column, overall: Column, min_support: int = 0,
               strength: float = PRIOR_STRENGTH) -> tuple[Column, Column, Column]:
    """Smoothed rate, its standard error and the lower 95 % bound.

    Below ``min_support`` rows the overall rate with standard error 1 is used.
    """
    rate = smoothed(hits, n, overall, strength)
    error = F.sqrt(rate * (1 - rate) / (n + strength))
    if min_support:
        thin = n < min_support
        rate = F.when(thin, overall).otherwise(rate)
        error = F.when(thin, F.lit(1.0)).otherwise(error)
    return rate, error, F.greatest(F.lit(0.0), rate - Z95 * error)


