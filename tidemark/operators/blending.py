"""Blends of score sets: fixed weights and grid searches with fold guard rails."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import AUC_WEIGHT, CLIP_HIGH, CLIP_LOW, ID, LABELS, LL_SCALE, LL_WEIGHT, SCORES
from tidemark.functions.probability import clip, log_loss_term, ordered
from tidemark.operators.metrics import fold_stats, metrics, regroup, weighted_score
from tidemark.sources.workspace import materialise


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    kept = {m: min(max(w, 0.0), 1.0) for m, w in weights.items()}
    total = sum(kept.values())
    return {m: w / total for m, w in kept.items()}


def coverage(oof: DataFrame, model: str = "model", row_id: str = ID) -> DataFrame:
    """Distinct scored rows per model and whether all models cover equally many."""
    per = oof.groupBy(model).agg(F.count_distinct(row_id).alias("covered"))
    low, high = per.select(F.min("covered")).scalar(), per.select(F.max("covered")).scalar()
    return per.withColumn("equal_coverage", (low == high).cast("int"))


def weighted_blend(oof: DataFrame, weights: dict[str, float], keep: list[str],
                   model: str = "model") -> DataFrame:
    """Weighted mean of the models' scores per row; ``keep`` names the row columns."""
    weight = F.lit(None).cast("double")
    for m, w in normalised_weights(weights).items():
        weight = F.when(F.col(model) == m, w).otherwise(weight)
    used = oof.withColumn("_w", weight).where(F.col("_w").isNotNull())
    return used.groupBy(*keep).agg(*[F.sum(F.col("_w") * F.col(p)).alias(p)
                                     for p in SCORES.values()])


def stacked_mean(left: DataFrame, right: DataFrame, row_id: str = ID) -> DataFrame:
    """Equal-weight mean of two systems, clipped and ordered; systems that score different rows are refused."""
    other = right.select(row_id, *[F.col(p).alias(f"_{p}") for p in SCORES.values()])
    for one, two in ((left, right), (right, left)):
        if not one.select(row_id).join(two.select(row_id), row_id, "left_anti").isEmpty():
            raise ValueError("both systems must score the same rows")
    both = left.join(other, row_id)
    mean = [clip((F.col(p) + F.col(f"_{p}")) / 2) for p in SCORES.values()]
    return both.select(row_id, *[c.alias(p) for c, p in zip(ordered(*mean), SCORES.values())])


def mean_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over fold models per row."""
    return scored.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in SCORES.values()])


def simplex_grid(models: list[str], steps: int) -> list[dict[str, float]]:
    """All weight sets on the simplex with the given number of steps per unit."""
    grid = []
    for head in product(range(steps + 1), repeat=len(models) - 1):
        rest = steps - sum(head)
        if rest >= 0:
            grid.append({m: k / steps for m, k in zip(models, (*head, rest))})
    return grid


def around(best: dict[str, float], steps: int, fine: int) -> list[dict[str, float]]:
    """Finer simplex points within one coarse step of the best weights."""
    near = [g for g in simplex_grid(list(best), steps * fine)
            if all(abs(g[m] - best[m]) <= 1 / steps + 1e-9 for m in best)]
    return near


def side_by_side(oof: DataFrame, models: list[str], model: str = "model",
                 row_id: str = ID) -> DataFrame:
    """One row per scored row with every model's scores: ``<score>_<i>``."""
    picks = [F.max(F.when(F.col(model) == m, F.col(p))).alias(f"{p}_{i}")
             for i, m in enumerate(models) for p in SCORES.values()]
    return oof.groupBy(row_id, "fold", *LABELS.values()).agg(*picks)


def _mixes(models: list[str], weight: Column) -> list[Column]:
    return [sum((weight[i] * F.col(f"{p}_{i}") for i in range(len(models))), F.lit(0.0)) for p in SCORES.values()]


def blend_scores(oof: DataFrame, models: list[str], grid: list[dict[str, float]]) -> DataFrame:
    """Weighted score and fold statistics of every weight set of the grid, in one job.

    The grid is a literal array: each row is mixed with every weight set and shrinks at once to a
    histogram per (weight set, fold, horizon, score).
    """
    points = F.array(*[F.struct(F.lit(i).alias("w_id"), F.array(*[F.lit(g[m]) for m in models])
                                .alias("w")) for i, g in enumerate(grid)])
    wide = side_by_side(oof, models).select("*", F.inline(points))
    parts = [F.struct(F.lit(h).alias("horizon"), mix.alias("p"), F.col(LABELS[h]).alias("y"))
             for h, mix in zip(LABELS, _mixes(models, F.col("w")))]
    long = wide.select("w_id", "fold", F.inline(F.array(*parts)))
    keys = ["w_id", "fold", "horizon"]
    fine = long.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    folds = fold_stats(weighted_score(metrics(fine, keys), ["w_id", "fold"]), ["w_id"])
    whole = metrics(regroup(fine, ["w_id", "horizon"]), ["w_id", "horizon"])
    out = weighted_score(whole, ["w_id"]).join(folds, "w_id")
    weights = [F.element_at(F.array(*[F.lit(g[m]) for g in grid]), F.col("w_id") + 1)
               .alias(f"w_{m}") for m in models]
    return out.select("w_id", *weights, "score", "fold_std", "worst_fold")


def best_blend(scored: DataFrame, baseline_worst: Column | float | None = None,
               spread_penalty: float = 0.0) -> DataFrame:
    """Best weight set: highest score less the fold-spread penalty, whose worst fold is not below
    the baseline; an infeasible best is returned (feasible = 0) only if nothing is feasible."""
    floor = F.lit(True) if baseline_worst is None else (F.col("worst_fold") >= baseline_worst)
    ranked = scored.withColumns({
        "feasible": floor.cast("int"),
        "objective": F.col("score") - spread_penalty * F.col("fold_std")})
    return ranked.orderBy(F.col("feasible").desc(), F.round("objective", 9).desc(), "w_id").limit(1)


def search_blend(oof: DataFrame, models: list[str], steps: int = 10, fine: int = 5,
                 baseline_worst: float | None = None, spread_penalty: float = 0.0) -> DataFrame:
    """Coarse grid, then a finer grid around its best point."""
    coarse = best_blend(blend_scores(oof, models, simplex_grid(models, steps)), baseline_worst,
                        spread_penalty).first()
    near = around({m: coarse[f"w_{m}"] for m in models}, steps, fine)
    return best_blend(blend_scores(oof, models, near), baseline_worst, spread_penalty)


# ---------------------------------------------------------------- search without copies of rows

#: Bins of a score's log-odds for the AUC of a candidate: 1/64 apart between odds of exp(-8) and exp(8).
BINS, REACH = 1024, 8.0


def sides(oof: DataFrame, systems: list[str]) -> DataFrame:
    """``fold, y, x``: the labels of each row and all systems' scores (horizon by horizon), written once.

    Every system must score every row once; anything else is refused.
    """
    counts = oof.where(F.col("model").isin(systems)).groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("m"))
    if not counts.where((F.col("n") != len(systems)) | (F.col("m") != len(systems))).isEmpty():
        raise ValueError("all systems must score the same rows, each once")
    wide = side_by_side(oof.where(F.col("model").isin(systems)), systems)
    x = F.array(*[F.col(f"{p}_{i}").cast("double") for p in SCORES.values() for i in range(len(systems))])
    return materialise(wide.select(F.col("fold").cast("int").alias("fold"), F.array(*[F.col(y).cast("double") for y in LABELS.values()]).alias("y"), x.alias("x")), "sides")


def _packed(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def histogram(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per horizon (column): rows by bin, positives by bin, and the summed loss."""
    out = np.zeros((p.shape[1], 2 * BINS + 1))
    at = np.clip((np.log(p / (1 - p)) + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)
    for h in range(p.shape[1]):
        out[h, :BINS] = np.bincount(at[:, h], minlength=BINS)
        out[h, BINS:-1] = np.bincount(at[:, h], weights=y[:, h], minlength=BINS)
    out[:, -1] = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(0)
    return out


def judged(table: DataFrame, candidates: np.ndarray, folds: list[int]) -> list[dict[str, float]]:
    """Score, fold spread and worst fold of every candidate (weights of the systems), in one pass over the rows.

    A task mixes its rows with all candidates at once and keeps, per candidate, fold and horizon, the summed loss and
    a histogram of log-odds; these are added up in two steps. The AUC counts rows of one bin as ties.
    """
    count, horizons, places = len(candidates), len(LABELS), {f: i for i, f in enumerate(folds)}
    width = len(folds) * horizons
    shape = (width, 2 * BINS + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, len(folds), horizons, shape[1]))
        for batch in batches:
            fold = np.array([places[f] for f in batch.column("fold").to_pylist()], np.int64)
            y, x = _packed(batch.column("y")), _packed(batch.column("x")).reshape(batch.num_rows, horizons, -1)
            for k in np.unique(fold):
                own = fold == k
                for c, w in enumerate(candidates):
                    total[c, k] += histogram(np.clip(x[own] @ w, CLIP_LOW, CLIP_HIGH), y[own])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array([t.tobytes() for t in total], pa.binary())], names=["c", "t"])

    def add(group: pa.Table) -> pa.Table:
        out = np.zeros(width * shape[1])
        for t in group.column("t").to_pylist():
            out += np.frombuffer(t)
        return pa.table({"c": group.column("c").slice(0, 1), "t": pa.array([out.tobytes()], pa.binary())})
    parts = table.mapInArrow(sums, "c long, t binary").withColumn("salt", F.spark_partition_id() % 32)
    # Partial sums have one size, whatever they sum; the salt bounds how many meet in a task.
    parts = parts.groupBy("c", "salt").applyInArrow(add, "c long, t binary").groupBy("c").applyInArrow(add, "c long, t binary")
    out: list[dict[str, float]] = [{}] * count
    for r in parts.collect():
        t = np.frombuffer(r["t"]).reshape(len(folds), horizons, shape[1])
        per = [share(part) for part in t]
        out[r["c"]] = {"score": share(t.sum(0)), "fold_std": float(np.std(per)), "worst_fold": float(min(per))}
    return out


def share(parts: np.ndarray) -> float:
    """Weighted score from the histogram and loss of each horizon."""
    total = 0.0
    for h, part in zip(LABELS, parts):
        n, pos = part[:BINS], part[BINS:-1]
        neg = n - pos
        both = pos.sum() * neg.sum()
        auc = float((pos * (np.cumsum(neg) - neg / 2)).sum() / both) if both else 0.5
        total += AUC_WEIGHT[h] * auc + LL_WEIGHT[h] * (1 - float(part[-1]) / max(n.sum(), 1) / LL_SCALE)
    return float(total)


def _rank(found: dict[str, float], floor: float | None, penalty: float) -> tuple[bool, float]:
    return floor is None or found["worst_fold"] >= floor, found["score"] - penalty * found["fold_std"]


def descend(table: DataFrame, systems: list[str], floor: float | None = None, penalty: float = 0.0, first: float = 0.25, last: float = 0.004) -> dict:
    """Weights on the simplex with the best score less ``penalty`` times the fold spread, the worst fold not below ``floor``.

    From the best of the even mix, the single systems and their pairs, each step tries to move some weight from every system to every other,
    all in one pass, and goes to the best; when none is better, the step halves, down to ``last``. Feasible points
    come before others. Returns weights, their figures and the number of passes.
    """
    m = len(systems)
    folds = sorted(r["fold"] for r in table.select("fold").distinct().collect())
    starts = [np.full(m, 1 / m), *np.eye(m), *[(a + b) / 2 for i, a in enumerate(np.eye(m)) for b in np.eye(m)[:i]]]
    tried = judged(table, np.array(starts), folds)
    at = max(range(len(starts)), key=lambda i: _rank(tried[i], floor, penalty))
    best, now, step, passes = starts[at], tried[at], first, 1
    while step >= last and m > 1:
        moves = []
        for i in range(m):
            give = min(step, best[i])
            if give > 0:
                for j in range(m):
                    if j != i:
                        w = best.copy()
                        w[i], w[j] = w[i] - give, w[j] + give
                        moves.append(w)
        tried = judged(table, np.array(moves), folds)
        passes += 1
        at = max(range(len(moves)), key=lambda i: _rank(tried[i], floor, penalty))
        here, there = _rank(now, floor, penalty), _rank(tried[at], floor, penalty)
        if (there[0], there[1] - 1e-9) > here:
            best, now = moves[at], tried[at]
        else:
            step /= 2
    return {"weights": dict(zip(systems, best.tolist())), **now, "feasible": _rank(now, floor, penalty)[0], "passes": passes}


def calibrator_blend(long: DataFrame, calibrators: list[str], steps: int = 10) -> DataFrame:
    """Weights over calibrators with the least 7-day log-loss after ordering the horizons.

    ``long`` is OOF-shaped with the calibrator name in ``model``.
    """
    grid = simplex_grid(calibrators, steps)
    points = F.array(*[F.struct(F.lit(i).alias("w_id"), F.array(*[F.lit(g[m]) for m in calibrators])
                                .alias("w")) for i, g in enumerate(grid)])
    wide = side_by_side(long, calibrators).select("*", F.inline(points))
    first, _, _ = ordered(*_mixes(calibrators, F.col("w")))
    loss = wide.groupBy("w_id").agg(F.avg(log_loss_term(first, F.col(LABELS["07"]))).alias("ll07"))
    weights = [F.element_at(F.array(*[F.lit(g[m]) for g in grid]), F.col("w_id") + 1)
               .alias(f"w_{m}") for m in calibrators]
    return loss.orderBy(F.round("ll07", 9), "w_id").limit(1).select("w_id", *weights, "ll07")
