"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are the words and word beginnings that it holds, hashed. Grades are ordered, 0 being harmless:
P(grade <= k) = logistic(theta_k - w x) with one weight vector for all thresholds. The severity is the expected grade.

Features are chosen by how strongly they go with a grade above 0 in the training rows (z-score of the log odds);
``width`` of them get weights. The fit is a limited-memory quasi-Newton descent whose loss and gradient are summed
over partitions, so only vectors of that fixed width reach the driver. Rows above grade 0, which are few, count ``emphasis`` times.

Training rows: those labelled and not held out, by the contract's rule, about ``max_fit`` of them by a hash of the id;
that bound makes the label table small enough to send to the scan. Only the text enters a score.

Defined cases: a null or wordless text has the score of a text without features; a null label is no label, repeated
labels of an id take the highest; without training rows, or with a single grade, all scores are 0; a null id is not held out;
repeated rows are scored alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.tables import held_out, two, write

BITS, PREFIXES, FIT_PARTITIONS = 18, (4, 6), 16


def features_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of a block, with repeats."""
    w = K.Words(texts, K.NON_ALNUM)
    size, mask = w.end - w.start, np.uint64((1 << BITS) - 1)
    rows, ids = [w.doc], [K.xxh64(w.data, w.start, size, 1) & mask]
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        rows.append(w.doc[longer])
        ids.append(K.xxh64(w.data, w.start[longer], np.full(len(longer), n), 1 + n) & mask)
    return np.concatenate(rows), np.concatenate(ids).astype(np.int64)


def _present(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows.astype(np.int64) << BITS | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    place: np.ndarray  # of each hashed feature among the weights, -1 for none
    weights: np.ndarray
    thresholds: np.ndarray  # rising; none if nothing was learned

    def link(self, texts: list[bytes]) -> np.ndarray:
        rows, ids = features_block(texts)
        at = self.place[ids]
        rows, at = _present(rows[at >= 0], at[at >= 0])
        return np.bincount(rows, self.weights[at], len(texts))

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return _logistic(self.link(texts)[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def loss_and_gradient(flat: np.ndarray, width: int, grade: np.ndarray, rows: np.ndarray, at: np.ndarray, emphasis: float = 1.0) -> np.ndarray:
    """Summed negative log likelihood and its gradient; parameters are weights, first threshold, log gaps.

    Rows of a grade above 0 count ``emphasis`` times.
    """
    w, theta = flat[:width], _thresholds(flat[width:])
    link = np.bincount(rows, w[at], len(grade))
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = _logistic(edges[grade + 1] - link), _logistic(edges[grade] - link)
    p = np.maximum(hi - lo, 1e-12)
    times = np.where(grade > 0, emphasis, 1.0)
    d_hi, d_lo = times * hi * (1 - hi) / p, times * lo * (1 - lo) / p
    d_theta = np.bincount(grade, -d_hi, len(theta) + 1)[:-1] + np.bincount(grade, d_lo, len(theta) + 1)[1:]
    gaps = np.exp(flat[width + 1:])
    tail = np.cumsum(d_theta[::-1])[::-1]
    return np.concatenate([[-(times * np.log(p)).sum()], np.bincount(at, (d_hi - d_lo)[rows], width), tail[:1], tail[1:] * gaps])


def _thresholds(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def minimise(value, x: np.ndarray, rounds: int, tolerance: float = 1e-4, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps; ``value`` gives loss and gradient in one vector."""
    now = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d = -now[1:]
        if np.abs(d).max() <= tolerance * max(1.0, abs(now[0])):
            break
        coefficients = []
        for s, y in reversed(steps):
            c = s @ d / (s @ y)
            coefficients.append(c)
            d = d - c * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.linalg.norm(d))
        for (s, y), c in zip(steps, reversed(coefficients), strict=True):
            d = d + s * (c - y @ d / (s @ y))
        size = 1.0
        for _ in range(20):
            then = value(x + size * d)
            if then[0] <= now[0] + 1e-4 * size * (now[1:] @ d):
                break
            size /= 2
        else:
            break
        s, y = size * d, then[1:] - now[1:]
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, now = x + s, then
    return x


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of the label table: 0 harmless, 1 toxic, 2 toxic in a text of low quality."""
    toxic, low = F.col("toxic").cast("int"), F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 0
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(toxic == 1, F.when(low, 2).otherwise(1)).when(toxic == 0, 0).alias("grade"))


def _sample(docs: DataFrame, graded: DataFrame, max_fit: int) -> DataFrame:
    """``doc_id, text, grade`` of about ``max_fit`` training rows."""
    marks = graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")).where(~held_out())
    share = min(1.0, max_fit / max(1, marks.count()))
    some = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return two(docs).join(F.broadcast(write(some, "marks")), "doc_id").select("doc_id", "text", "grade")


def _choose(sample: DataFrame, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen features, and the rows of each grade."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(64, np.int64)
        for rows in batches:
            grade = rows.column(2).to_numpy(zero_copy_only=False)
            seen += np.bincount(np.minimum(grade, 63), minlength=64)
            for a, b, texts in K.blocks(rows.column(1)):
                at, ids = _present(*features_block(texts))
                for k in (0, 1):
                    counts[k] += np.bincount(ids[(grade[a:b] > 0)[at] == bool(k)], minlength=1 << BITS)
        ids = np.flatnonzero(counts.sum(0))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"id": np.concatenate([ids, -1 - some]), "clean": np.concatenate([counts[0, ids], seen[some]]),
                                          "toxic": np.concatenate([counts[1, ids], 0 * some])})
    counts = write(sample.mapInArrow(run, "id long, clean long, toxic long").groupBy("id").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    seen = {-1 - r.id: r.clean for r in counts.where("id < 0").collect()}
    rows = np.zeros(max(seen, default=-1) + 1, np.int64)
    rows[list(seen)] = list(seen.values())
    place = np.full(1 << BITS, -1, np.int64)
    clean, toxic = float(rows[:1].sum()), float(rows[1:].sum())
    if clean and toxic:
        a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
        odds = F.log(a / (toxic - F.col("toxic") + 0.5)) - F.log(b / (clean - F.col("clean") + 0.5))
        strength = F.abs(odds) / F.sqrt(1 / a + 1 / b)
        best = (counts.where("id >= 0").where(F.col("clean") + F.col("toxic") >= least)
                .orderBy(strength.desc(), "id").limit(width).select("id").collect())
        place[[r.id for r in best]] = np.arange(len(best))
    return place, rows


def fit(docs: DataFrame, graded: DataFrame, width: int = 2048, least: int = 3, ridge: float = 2.0, rounds: int = 30,
        emphasis: float = 4.0, max_fit: int = 100_000) -> Model:
    """Fit on the graded rows of ``docs`` (``graded``: ``doc_id, grade``) that are not held out."""
    sample = _sample(docs, graded, max_fit)
    place, rows = _choose(sample, width, least)
    if (rows > 0).sum() < 2:
        return Model(place, np.zeros(0), np.zeros(0))
    width = int(place.max()) + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in K.blocks(batch.column(1)):
                row, ids = features_block(texts)
                row, at = _present(row[place[ids] >= 0], place[ids][place[ids] >= 0])
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_pydict({"grade": batch.column(2).slice(a, b - a), "at": [at[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]})
    chosen = write(sample.mapInArrow(pick, "grade int, at array<long>").coalesce(FIT_PARTITIONS), "toxicity-train")

    def value(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(x) + 1)
            for batch in batches:
                n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                at = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                total += loss_and_gradient(x, width, batch.column(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), at, emphasis)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})
        total = sum(np.frombuffer(r.sums) for r in chosen.mapInArrow(run, "sums binary").collect())
        total[0] += ridge / 2 * (x[:width] @ x[:width])
        total[1:width + 1] += ridge * x[:width]
        return total
    share = np.clip(np.cumsum(rows)[:-1] / rows.sum(), 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(width), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    x = minimise(value, start, rounds)
    return Model(place, x[:width], _thresholds(x[width:]))


def grade(docs: DataFrame, graded: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, severity`` (expected grade), ``score`` (of a grade above 0), ``predicted`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, graded, **settings))
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in K.blocks(rows.column(1)):
                above = model.value.above(texts) if len(model.value.thresholds) else np.zeros((b - a, 1))
                yield K.batch(schema, rows.column(0).slice(a, b - a), above.sum(1), above[:, 0])
    scored = two(docs).mapInArrow(run, "doc_id long, severity double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "severity", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
