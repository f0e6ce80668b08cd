"""Logistic models of many column sets and left-out folds, fitted together by partition-summed gradients.

All models minimise what Spark's ``LogisticRegression`` minimises with standardisation: the mean log-loss of their training rows plus
``penalty`` / 2 times the squares of the coefficients of columns scaled to deviation 1. One pass over the rows gives the exact loss and gradient of
every model that is still going; partial sums have the size of the models, whatever the number of rows. The driver takes a limited-memory
quasi-Newton step per pass, which starts from the exact second moments of the columns: these cost one pass per fold, not one per model.

``fit_frames`` fits the labels of all folds on the rows of each, with an elastic-net penalty: a pass also sums up the exact second derivatives, and
the driver solves the penalised quadratic problem that they make, so that a few passes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CLIP_HIGH, CLIP_LOW
from tidemark.functions.probability import clip
from tidemark.sources.workspace import discard, materialise

#: Rows that are multiplied at once, and steps that are remembered.
_CHUNK, _MEMORY = 8192, 20
#: Rows of a record that an elastic net is fitted on.
_RECORD = 2048
#: A fit ends when a Newton step would lower the loss by no more than this share of it.
TOLERANCE = 1e-10
#: A model: the name of its column set and the fold that it leaves out.
Key = tuple[str, int]


def _sums(rows: DataFrame, columns: list[str], label: str, add) -> dict[int, np.ndarray]:
    """By fold, the sums of the vectors that ``add(fold, x, y)`` makes of the rows; each partition sends one vector a fold."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for fold, x, y in _chunks(batches, columns, label):
            more = add(fold, x, y)
            total[fold] = total[fold] + more if fold in total else more
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["f", "t"])
    return _joined(rows.select("fold", label, *columns).mapInArrow(partial, "f long, t binary"))


def _joined(parts: DataFrame) -> dict[int, np.ndarray]:
    """By number, the sums of the partitions' vectors (``f, t``)."""
    def join(group: pa.Table) -> pa.Table:
        out = 0
        for t in group.column("t"):
            out = out + np.frombuffer(t.as_py())
        return pa.table({"f": group.column("f").slice(0, 1), "t": pa.array([out.tobytes()], pa.binary())})
    parts = parts.withColumn("salt", F.spark_partition_id() % 32)
    parts = parts.groupBy("f", "salt").applyInArrow(join, "f long, t binary").groupBy("f").applyInArrow(join, "f long, t binary")
    return {r["f"]: np.frombuffer(r["t"]) for r in parts.collect()}


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str], label: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each fold in a batch as a matrix, and their labels."""
    for batch in batches:
        if not batch.num_rows:
            continue
        folds, y = batch.column("fold").to_numpy(), batch.column(label).to_numpy(zero_copy_only=False).astype(float)
        x = np.empty((batch.num_rows, len(columns)))
        for i, c in enumerate(columns):
            x[:, i] = batch.column(c).to_numpy(zero_copy_only=False)
        for fold in np.unique(folds).tolist():
            some = np.flatnonzero(folds == fold)
            for lo in range(0, len(some), _CHUNK):
                at = some[lo:lo + _CHUNK]
                yield fold, x[at], y[at]


class _Fit:
    """One model on its way: preconditioned limited-memory steps, each halved until the loss falls enough."""

    def __init__(self, at: np.ndarray, curvature: np.ndarray):
        values, vectors = np.linalg.eigh(curvature)
        kept = values > max(values.max(), 0) * 1e-12
        self.root = vectors[:, kept] / np.sqrt(values[kept])
        self.at, self.loss, self.slope = at, np.inf, np.zeros_like(at)
        self.move, self.step, self.steps, self.done = np.zeros_like(at), 1.0, 0, False
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []

    def solved(self, g: np.ndarray) -> np.ndarray:
        return self.root @ (self.root.T @ g)

    def trial(self) -> np.ndarray:
        return self.at + self.step * self.move

    def take(self, loss: float, slope: np.ndarray, most: int) -> None:
        """Loss and gradient of the trial point."""
        if self.loss < np.inf:
            fall = self.slope @ self.move
            if not loss <= self.loss + 1e-4 * self.step * fall:
                self.step /= 2
                # What is left to gain is below the rounding of the sums.
                self.done = self.step < 1e-10 or -fall * self.step <= 1e-15 * self.loss
                return
            s, y = self.step * self.move, slope - self.slope
            if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
                self.seen = [*self.seen, (s, y)][-_MEMORY:]
            self.at, self.steps = self.at + s, self.steps + 1
        self.loss, self.slope = loss, slope
        left = float(slope @ self.solved(slope)) / 2
        self.done = left <= TOLERANCE * loss or self.steps >= most
        q, parts = slope.copy(), []
        for s, y in reversed(self.seen):
            a = (s @ q) / (s @ y)
            parts.append(a)
            q = q - a * y
        r = self.solved(q)
        for (s, y), a in zip(self.seen, reversed(parts), strict=True):
            r = r + s * (a - (y @ r) / (s @ y))
        self.move, self.step = -r, 1.0


def fit(rows: DataFrame, sets: dict[str, list[str]], label: str, penalty: float, iterations: int) -> dict[Key, tuple[dict[str, float], float]]:
    """``(coefficients by column, intercept)`` by set and fold: each is fitted on the rows (``fold``, label, columns) of the other folds.

    ``rows`` should be a written table: it is read once per step. A fit with one class only has an infinite intercept, and
    columns that do not vary in the training rows have coefficient 0, as in Spark.
    """
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    place, width = {c: i for i, c in enumerate(columns)}, len(columns)
    first = _sums(rows, columns, label, lambda fold, x, y: np.concatenate([[len(y)], x.sum(0)]))
    middle = sum(t[1:] for t in first.values()) / sum(t[0] for t in first.values())

    def moments(fold: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.ones((len(x), 1)), x - middle], axis=1)
        return np.concatenate([[y.sum()], (z.T @ z).ravel()])
    held = _sums(rows, columns, label, moments)
    whole = sum(held.values())
    fits: dict[Key, _Fit] = {}
    scale, out, sizes = {}, {}, {}
    for f in sorted(held):
        rest = whole - held[f]
        square = rest[1:].reshape(width + 1, width + 1)
        n, positive = float(square[0, 0]), float(rest[0])
        if n < 1:
            raise ValueError(f"no training rows without fold {f}")
        sizes[f] = n
        shift = square[0, 1:] / n
        spread = square[1:, 1:] - n * np.outer(shift, shift)
        variance = np.diag(spread) / max(n - 1, 1)
        # Rounding of the sums leaves a trace of a column that does not vary.
        size = np.diag(square)[1:] / n
        deviation = np.sqrt(np.where(variance > 1e-13 * (size + middle ** 2), variance, 0))
        scale[f] = shift, deviation
        share = positive / n
        for name, own in sets.items():
            if positive in (0, n):
                out[name, f] = dict.fromkeys(own, 0.0), np.inf if positive else -np.inf
                continue
            at = np.array([place[c] for c in own if deviation[place[c]] > 0], int)
            curvature = np.zeros((len(at) + 1, len(at) + 1))
            curvature[0, 0] = share * (1 - share)
            curvature[1:, 1:] = share * (1 - share) * spread[np.ix_(at, at)] / n / np.outer(deviation[at], deviation[at]) + penalty * np.eye(len(at))
            start = np.zeros(len(at) + 1)
            start[0] = np.log(share / (1 - share))
            fits[name, f] = _Fit(start, curvature)
    used = {(name, f): np.array([place[c] for c in own if scale[f][1][place[c]] > 0], int) for name, own in sets.items() for f in held}

    while going := [k for k, m in fits.items() if not m.done]:
        # Weights of the shifted columns by model; columns are centred and scaled by the training rows of the model's fold.
        weights, offsets = np.zeros((width, len(going))), np.zeros(len(going))
        for j, k in enumerate(going):
            shift, deviation = scale[k[1]]
            at, point = used[k], fits[k].trial()
            weights[at, j] = point[1:] / deviation[at]
            offsets[j] = point[0] - weights[:, j] @ shift
        fold_of = np.array([f for _, f in going])

        def losses(fold: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            mine = np.flatnonzero(fold_of != fold)
            out, z = np.zeros((len(going), width + 2)), x - middle
            margin = z @ weights[:, mine] + offsets[mine]
            away = np.exp(-np.abs(margin))
            out[mine, 0] = (np.log1p(away) + np.maximum(margin, 0)).sum(0) - y @ margin
            error = np.where(margin >= 0, 1, away) / (1 + away) - y[:, None]
            out[mine, 1], out[mine, 2:] = error.sum(0), error.T @ z
            return out.ravel()
        total = sum(_sums(rows, columns, label, losses).values()).reshape(len(going), -1)
        for j, k in enumerate(going):
            (shift, deviation), at, point, n = scale[k[1]], used[k], fits[k].trial(), sizes[k[1]]
            slope = np.concatenate([[total[j, 1] / n], (total[j, 2:] - total[j, 1] * shift)[at] / deviation[at] / n + penalty * point[1:]])
            fits[k].take(float(total[j, 0] / n + penalty / 2 * (point[1:] @ point[1:])), slope, iterations)
    for (name, f), model in fits.items():
        at, (shift, deviation) = used[name, f], scale[f]
        found = dict.fromkeys(sets[name], 0.0) | {columns[i]: float(v) for i, v in zip(at, model.at[1:] / deviation[at], strict=True)}
        out[name, f] = found, float(model.at[0] - sum(found[columns[i]] * (shift[i] + middle[i]) for i in at))
    return out


def score(rows: DataFrame, fitted: dict[Key, tuple[dict[str, float], float]], label: str, name: str) -> DataFrame:
    """``name`` (of the column set), ``p`` and ``y``: every row under each set's model that left the row's fold out, in one pass."""
    columns = list(dict.fromkeys(c for found, _ in fitted.values() for c in found))
    names = sorted({n for n, _ in fitted})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, x, y in _chunks(batches, columns, label):
            for n in names:
                found, intercept = fitted[n, fold]
                margin = np.clip(x @ np.array([found.get(c, 0.0) for c in columns]) + intercept, -700, 700)
                p = np.clip(1 / (1 + np.exp(-margin)), CLIP_LOW, CLIP_HIGH)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(y), pa.string()), pa.array(p), pa.array(y)], names=[name, "p", "y"])
    return rows.select("fold", label, *columns).mapInArrow(run, f"`{name}` string, p double, y double")


# ---------------------------------------------------------------- elastic nets of all folds and labels

def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution, or the least one where columns depend on each other."""
    try:
        v = np.linalg.solve(a, b)
        if np.abs(a @ v - b).max(initial=0) <= 1e-12 * np.abs(b).max(initial=0):
            return v
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _quadratic(a: np.ndarray, c: np.ndarray, l1: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least ``c u + u a u / 2 + l1 |u|``, by feature-sign search: exact on the coordinates that are not 0 with their signs, one of which
    comes in where the slope asks for it, and some of which go where they would change their sign on the way."""
    def value(v: np.ndarray) -> float:
        return float(c @ v + v @ a @ v / 2 + l1 @ np.abs(v))
    u, free = u.copy(), (l1 == 0) & (np.diag(a) > 0)
    sign, slack = np.sign(u), 1e-10 * max(np.abs(c).max(), 1e-300)
    for _ in range(20 * len(u)):
        own = np.flatnonzero(free | (sign != 0))
        v = np.zeros_like(u)
        v[own] = _solved(a[np.ix_(own, own)], -c[own] - (l1 * sign)[own])
        turned = own[(l1[own] > 0) & (v[own] * sign[own] <= 0)]
        if len(turned):
            # The best of the points on the way at which a coordinate is 0.
            ways = [t for t in np.unique(u[turned] / np.where(u[turned] == v[turned], 1, u[turned] - v[turned])) if 0 < t <= 1]
            tried = [u + t * (v - u) for t in ways]
            for t, w in zip(ways, tried, strict=True):
                w[turned[np.abs(w[turned]) <= 1e-14 * np.abs(v - u)[turned]]] = 0
            tried.append(np.where(np.isin(np.arange(len(u)), turned) & (u == 0), 0, u))
            u = min(tried, key=value)
            sign = np.sign(u) * (l1 > 0)
            if len(ways):
                continue
        else:
            u = v
        slope = np.where((l1 > 0) & (u == 0) & (np.diag(a) > 0), np.abs(c + a @ u) - l1, 0)
        j = int(slope.argmax())
        if slope[j] <= slack:
            break
        sign = np.sign(u) * (l1 > 0)
        sign[j] = -np.sign((c + a @ u)[j])
    return u


class _Net:
    """One elastic net on its way: penalised Newton steps, each halved until the loss falls enough."""

    def __init__(self, trial: np.ndarray, l1: float, l2: float):
        self.l1, self.l2 = (np.concatenate([[0.0], np.full(len(trial) - 1, v)]) for v in (l1, l2))
        self.trial, self.at, self.total, self.steps, self.done = trial, trial, np.inf, 0, False

    def whole(self, loss: float, u: np.ndarray) -> float:
        return loss + float(self.l1 @ np.abs(u) + self.l2 @ (u * u) / 2)

    def take(self, loss: float, slope: np.ndarray, curve: np.ndarray, most: int) -> None:
        """Loss, gradient and second derivatives at the trial point."""
        total = self.whole(loss, self.trial)
        if not (np.isfinite(total) and np.isfinite(curve).all()):
            self.at, self.done = np.full_like(self.at, np.nan), True
            return
        if self.total < np.inf and not total <= self.total - 1e-4 * self.step * self.gain:
            self.step /= 2
            # What is left to gain is below the rounding of the sums.
            self.done = self.step < 1e-10 or self.gain * self.step <= 1e-15 * self.total
            self.trial = self.at + self.step * self.move
            return
        self.at, self.total, self.steps = self.trial, total, self.steps + 1
        best = _quadratic(curve + np.diag(self.l2), slope - curve @ self.at, self.l1, self.at)
        self.move, self.step = best - self.at, 1.0
        after = loss + slope @ self.move + self.move @ curve @ self.move / 2
        self.gain = max(total - self.whole(float(after), best), 0.0)
        self.done = self.gain <= TOLERANCE * total or self.steps > most
        self.trial = best


def fit_frames(frames: list[tuple[int, DataFrame]], columns: list[str], labels: list[str], penalties: dict[int, float], l1_share: float = 0.0,
               scaled: bool = True, iterations: int = 100) -> dict[tuple[int, str], tuple[np.ndarray, float]]:
    """``(coefficients, intercept)`` by fold and label, each fitted on its fold's rows.

    They minimise what Spark's ``LogisticRegression`` minimises: the mean log-loss plus the fold's penalty, with ``scaled`` on columns scaled to
    deviation 1. A pass over the rows of all folds is a step of all models; partial sums have the size of their second derivatives.
    """
    rows = None
    for number, own in frames:
        part = own.select(F.lit(number).alias("fold"), *[F.col(c).cast("double").alias(c) for c in (*labels, *columns)])
        rows = part if rows is None else rows.unionByName(part)
    width = len(columns)
    stats = [e for i, c in enumerate(columns) for e in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"d{i}"))] if scaled else []
    found = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(f"y{j}") for j, y in enumerate(labels)], *stats).collect()}
    place: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = {f: found[f]["n"] if f in found else 0 for f, _ in frames}
    if missing := [f for f, n in sizes.items() if not n]:
        raise ValueError(f"no training rows for {missing}")
    fits: dict[tuple[int, str], _Net] = {}
    out: dict[tuple[int, str], tuple[np.ndarray, float]] = {}
    for f, r in found.items():
        middle, deviation = np.zeros(width), np.ones(width)
        if scaled:
            middle, deviation = (np.array([np.nan if r[f"{v}{i}"] is None else r[f"{v}{i}"] for i in range(width)]) for v in "md")
            deviation = np.where(np.isnan(deviation), 0.0, deviation)
        # A column that does not vary has coefficient 0.
        place[f] = middle, np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 1e-13 * np.abs(middle))
        for j, y in enumerate(labels):
            share = r[f"y{j}"] / sizes[f]
            if share in (0, 1):
                out[f, y] = np.zeros(width), np.inf if share else -np.inf
                continue
            start = np.zeros(width + 1)
            start[0] = np.log(share / (1 - share))
            fits[f, y] = _Net(start, penalties[f] * l1_share, penalties[f] * (1 - l1_share))
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for f in np.unique(folds).tolist():
                some = batch.filter(pa.array(folds == f))
                for lo in range(0, some.num_rows, _RECORD):
                    part = some.slice(lo, _RECORD)
                    z = np.stack([(part.column(c).to_numpy(zero_copy_only=False) - m) * d for c, m, d in zip(columns, *place[f], strict=True)])
                    y = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in labels])
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([z.astype(np.float32).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())],
                                                     names=["fold", "z", "y"])
    # Written once, in the form that the passes take.
    packed = materialise(rows.mapInArrow(pack, "fold int, z binary, y binary"), "nets")

    while going := [k for k, m in fits.items() if not m.done]:
        points = {f: [(labels.index(y), fits[f, y].trial) for g, y in going if g == f] for f in {g for g, _ in going}}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, zs, ys in zip(*(batch.column(c).to_pylist() for c in ("fold", "z", "y")), strict=True):
                    held = total.setdefault(f, np.zeros((len(points[f]), 1 + (width + 1) * (width + 2))))
                    sides = np.frombuffer(ys).reshape(len(labels), -1)
                    z = np.ones((width + 1, sides.shape[1]))
                    z[1:] = np.frombuffer(zs, np.float32).reshape(width, -1)
                    for own, (j, point) in zip(held, points[f], strict=True):
                        y, margin = sides[j], point @ z
                        away = np.exp(-np.abs(margin))
                        p = np.where(margin >= 0, 1, away) / (1 + away)
                        own[0] += (np.log1p(away) + np.maximum(margin, 0)).sum() - y @ margin
                        own[1:width + 2] += z @ (p - y)
                        own[width + 2:] += ((z * (p * (1 - p))) @ z.T).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["f", "t"])
        sums = _joined(packed.where(F.col("fold").isin(list(points))).mapInArrow(partial, "f long, t binary"))
        for f, own in points.items():
            for (j, _), t in zip(own, sums[f].reshape(len(own), -1) / sizes[f], strict=True):
                fits[f, labels[j]].take(float(t[0]), t[1:width + 2], t[width + 2:].reshape(width + 1, width + 1), iterations)
    discard(packed)
    for (f, y), model in fits.items():
        middle, scale = place[f]
        weights = model.at[1:] * scale
        out[f, y] = weights, float(model.at[0] - weights @ np.where(scale > 0, middle, 0))
    return out


def probability(columns: list[str], weights: np.ndarray, intercept: float) -> Column:
    """The positive-class probability under one model, clipped."""
    margin = F.lit(float(intercept))
    for c, w in zip(columns, weights.tolist(), strict=True):
        if w:
            margin = margin + F.col(c).cast("double") * F.lit(w)
    return clip(1 / (1 + F.exp(-margin)))
