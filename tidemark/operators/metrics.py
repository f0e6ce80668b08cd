"""Exact distributed metrics of probability scores.

Everything starts from one histogram: rows and positives per distinct score. It combines on the
map side, and every metric below reads the histogram, never the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import AUC_WEIGHT, ID, LABELS, LL_SCALE, LL_WEIGHT, SCORES
from tidemark.functions.probability import log_loss_term
from tidemark.operators.ranking import (BUCKET, cumulative_counts, ordered_position, score_bucket)


def long_scores(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide scores and labels to one row per horizon: (keys, horizon, p, y)."""
    parts = [F.struct(F.lit(h).alias("horizon"), F.col(SCORES[h]).alias("p"),
                      F.col(LABELS[h]).alias("y")) for h in LABELS]
    return wide.select(*keys, F.inline(F.array(*parts)))


def score_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def regroup(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram of coarser keys, from the finer one."""
    return hist.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def log_loss(hist: DataFrame, keys: list[str]) -> DataFrame:
    loss = F.sum(F.col("n") * log_loss_term(F.col("p"), F.col("pos") / F.col("n")))
    return hist.groupBy(*keys).agg((loss / F.sum("n")).alias("log_loss"))


def metrics(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, positives, log-loss and ROC-AUC (ties count half, one class gives 0.5) per key.

    Negatives below a score are counted inside its score bucket, then bucket totals are
    accumulated, so no window holds more than one bucket or the list of buckets.
    """
    p, n, pos = F.col("p"), F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    cells = hist.select(*keys, "p", n.alias("n"), pos.alias("pos"), neg.alias("neg"),
                        (-(pos * F.ln(p) + neg * F.ln(1 - p))).alias("loss"),
                        score_bucket(p).alias(BUCKET))
    inner = (Window.partitionBy(*keys, BUCKET).orderBy("p")
             .rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(F.sum("neg").over(inner), F.lit(0.0))
    cells = cells.withColumn("pairs", F.col("pos") * (below + 0.5 * F.col("neg")))
    buckets = cells.groupBy(*keys, BUCKET).agg(
        *[F.sum(c).alias(c) for c in ("n", "pos", "neg", "loss", "pairs")])
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(BUCKET)
    under = F.coalesce(F.sum("neg").over(outer.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0.0))
    buckets = buckets.withColumn("pairs", F.col("pairs") + F.col("pos") * under)
    both = F.sum("pos") * F.sum("neg")
    return buckets.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"), F.sum("pos").cast("long").alias("pos"),
        (F.sum("loss") / F.sum("n")).alias("log_loss"),
        F.when(both > 0, F.sum("pairs") / both).otherwise(0.5).alias("roc_auc"))


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    return metrics(score_histogram(rows, keys), keys).select(*keys, "roc_auc")


def score_share(horizon: Column, loss: Column, auc: Column) -> Column:
    """Contribution of one horizon to the weighted score."""
    expr = F.lit(None).cast("double")
    for h in LABELS:
        share = AUC_WEIGHT[h] * auc + LL_WEIGHT[h] * (1 - loss / LL_SCALE)
        expr = F.when(horizon == h, share).otherwise(expr)
    return expr


def weighted_score(per_horizon: DataFrame, keys: list[str]) -> DataFrame:
    share = score_share(F.col("horizon"), F.col("log_loss"), F.col("roc_auc"))
    return per_horizon.groupBy(*keys).agg(F.sum(share).alias("score"))


def combined_loss(per_horizon: DataFrame) -> DataFrame:
    return per_horizon.withColumn("combined_loss",
                                  0.75 * F.col("log_loss") + 0.25 * (1 - F.col("roc_auc")))


def cv_summary(per_fold: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    c = combined_loss(per_fold)
    return c.groupBy(*keys).agg(
        F.avg("log_loss").alias("mean_log_loss"), F.stddev_pop("log_loss").alias("std_log_loss"),
        F.avg("roc_auc").alias("mean_roc_auc"), F.stddev_pop("roc_auc").alias("std_roc_auc"),
        F.avg("combined_loss").alias("mean_combined"))


def fold_stats(per_fold_score: DataFrame, keys: list[str]) -> DataFrame:
    """Spread, worst and last fold of the per-fold weighted score."""
    return per_fold_score.groupBy(*keys).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("fold_std"),
        F.min("score").alias("worst_fold"), F.max_by("score", "fold").alias("last_fold"))


def run_summary(oof: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run: weighted score, LL and AUC per horizon, fold spread.

    ``oof`` is wide: keys, fold, scores, labels. Fold and overall metrics share one histogram.
    """
    fine = score_histogram(long_scores(oof, [*keys, "fold"]), [*keys, "fold", "horizon"])
    whole = metrics(regroup(fine, [*keys, "horizon"]), [*keys, "horizon"])
    folds = fold_stats(weighted_score(metrics(fine, [*keys, "fold", "horizon"]), [*keys, "fold"]),
                       keys)
    columns = [F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"{short}{h}")
               for h in LABELS for m, short in (("log_loss", "ll"), ("roc_auc", "auc"))]
    share = score_share(F.col("horizon"), F.col("log_loss"), F.col("roc_auc"))
    overall = whole.groupBy(*keys).agg(F.sum(share).alias("score"), *columns)
    return overall.join(folds, keys)


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision over distinct thresholds, with prevalence and row count."""
    cum = cumulative_counts(rows, keys, "p", {"pos": F.col("y")}, descending=True)
    reached = F.col("pos_before") + F.col("pos")
    precision = reached / (F.col("n_before") + F.col("n"))
    return cum.groupBy(*keys).agg(
        (F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))).alias("avg_precision"),
        (F.sum("pos") / F.sum("n")).alias("prevalence"), F.sum("n").alias("n_rows"))


def recall_at(rows: DataFrame, keys: list[str], shares: list[float],
              row_id: str = ID) -> DataFrame:
    """Share of positives among the top ceil(n * share) rows; equal scores are cut by row id.

    Scores above the cut count whole; only rows that tie with the cut score are put in id order,
    by a distributed sort, since the tie may hold any number of rows.
    """
    cum = cumulative_counts(rows, keys, "p", {"pos": F.col("y")}, descending=True)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_pos"))
    wanted = sizes.select("*", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    wanted = wanted.withColumn("_k", F.ceil(F.col("_n") * F.col("share")))
    # One row per (key, share): keys name runs and horizons, never data values.
    scored = cum.join(F.broadcast(wanted), keys)
    above = (F.col("n_before") + F.col("n")) <= F.col("_k")
    whole = scored.groupBy(*keys, "share", "_pos").agg(
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("_sure"))
    cut = scored.where(~above & (F.col("n_before") < F.col("_k"))).select(
        *keys, "share", "p", (F.col("_k") - F.col("n_before")).alias("_take"))
    tied = rows.select(*keys, row_id, "p", "y").join(F.broadcast(cut), [*keys, "p"])
    placed = ordered_position(tied, [*keys, "share"], [F.col(row_id)], "_pos_in_tie")
    extra = (placed.where(F.col("_pos_in_tie") <= F.col("_take"))
             .groupBy(*keys, "share").agg(F.sum("y").alias("_extra")))
    hits = F.col("_sure") + F.coalesce("_extra", F.lit(0))
    return (whole.join(extra, [*keys, "share"], "left")
            .select(*keys, "share", (hits / F.nullif(F.col("_pos"), F.lit(0))).alias("recall")))


def top_k(rows: DataFrame, score: str, k: int, row_id: str = ID) -> DataFrame:
    """The k best rows by score, ties by row id (a top-k report)."""
    return rows.orderBy(F.col(score).desc(), F.col(row_id)).limit(k)


def expected_log_loss(p: Column, rate: float) -> Column:
    """Mean log-loss if the given share of rows were positive."""
    def ln(x: Column) -> Column:
        return F.ln(F.least(F.greatest(x, F.lit(1e-15)), F.lit(1.0)))
    return -(1 - rate) * F.avg(ln(1 - p)) - rate * F.avg(ln(p))


def separation_auc(rows: DataFrame, keys: list[str], rates: dict[str, float]) -> DataFrame:
    """Heuristic AUC from the mean of the top and the bottom expected-positive rows.

    Reads the cumulative histogram: a score contributes as many of its rows as still fit.
    """
    cum = cumulative_counts(rows, keys, "p")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rate = F.lit(None).cast("double")
    for h, r in rates.items():
        rate = F.when(F.col("horizon") == h, r).otherwise(rate)
    sizes = sizes.withColumn("_k", F.floor(F.col("_n") * rate))
    c = cum.join(F.broadcast(sizes), keys)  # one row per key
    after = F.col("_n") - F.col("n_before") - F.col("n")

    def take(passed: Column) -> Column:
        return F.least(F.greatest(F.col("_k") - passed, F.lit(0)), F.col("n"))

    low = F.sum(F.col("p") * take(F.col("n_before")))
    high = F.sum(F.col("p") * take(after))
    k = F.max("_k")
    auc = F.when(k > 0, F.least(F.greatest(0.5 + 0.5 * (high / k - low / k), F.lit(0.5)),
                                F.lit(1.0))).otherwise(0.5)
    return c.groupBy(*keys).agg(auc.alias("est_auc"))


def monotone(oof: DataFrame, keys: list[str]) -> DataFrame:
    ok = (F.col("p07") <= F.col("p90")) & (F.col("p90") <= F.col("p120"))
    return oof.groupBy(*keys).agg(F.bool_and(ok).cast("int").alias("monotone"))


def feature_correlations(rows: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """Pearson correlation of every feature with every label, from one aggregate row; NULL without spread."""
    pairs = [(f, y) for f in features for y in labels]
    wide = rows.agg(*[F.covar_pop(F.col(f).cast("double"), F.col(y).cast("double")).alias(f"c{i}") for i, (f, y) in enumerate(pairs)],
                    *[F.stddev_pop(c).alias(f"spread_{c}") for c in [*features, *labels]])
    rows_out = [F.struct(F.lit(f).alias("feature"), F.lit(y).alias("label"), F.try_divide(
        f"c{i}", F.col(f"spread_{f}") * F.col(f"spread_{y}")).alias("correlation")) for i, (f, y) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows_out)))
