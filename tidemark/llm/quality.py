"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Every whole text becomes a few statistics. A fixed random cosine map of the standardised statistics
approximates a Gaussian kernel; the normal equations of a ridge fit on it are sums over rows, so
partitions add them up and the driver solves one small system per fold. Out-of-fold scores are
binned and pooled into a monotone map from raw score to probability. What reaches the driver
(feature moments, folds x (width + 1)^2 sums, ``BINS`` bins) has a fixed size at any input.

Training rows: labelled, not held out, at most about ``max_fit`` of them, taken by a hash of the id.
Only the text enters a score.

Defined cases: null and empty texts have the statistics of an empty text and a score like any
other; a label that is null is no label, repeated labels of an id are averaged; without any
training label every score is 0.5 and predicted 1; a null id is not held out; repeated rows are
scored alike; an empty table gives an empty table.
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

FOLDS, BINS, BLOCKS, FIT_PARTITIONS = 4, 2048, 16, 64

#: Byte classes, counted per document.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 7, 8
_CLASS[33:127] = 6
for _at, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r",
                              b"\n", b".,;:'\"-()?")):
    _CLASS[list(_chars)] = _at
FEATURES = ["bytes", "words", "lines", "upper", "lower", "digit", "blank", "newline", "stop", "symbol", "tail",
            "lead", "control", "word_mean", "word_spread", "repeat", "distinct", "line_distinct", "ended",
            "capital", "symbol_words"]


def statistics_block(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(texts)
    size = np.fromiter((len(t) for t in texts), np.int64, n)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    kinds = np.bincount(doc * 10 + _CLASS[flat], minlength=10 * n).reshape(n, 10)
    w = K.Words(texts, K.SPACES, lower=False)
    length = (w.end - w.start).astype(np.float64)
    h = K.xxh64(w.data, w.start, w.end - w.start)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    sums = lambda v: K.segment_sums(v, w.count)
    kind = _CLASS[w.data]
    words = np.maximum(w.count, 1)
    mean = sums(length) / words
    spread = np.sqrt(np.maximum(sums(length * length) / words - mean * mean, 0))
    lines, distinct_lines = _lines(texts)
    chars = np.maximum(size, 1)[:, None]
    last = w.data[np.maximum(w.end - 1, 0)]
    columns = [np.log1p(size), np.log1p(w.count), np.log1p(lines), *(kinds / chars).T, mean, spread,
               sums(same) / words, _distinct(w.doc, h, n) / words, distinct_lines / np.maximum(lines, 1),
               sums(np.isin(last, list(b".!?")).astype(float)) / words,
               sums((kind[w.start] == 0).astype(float)) / words, sums((kind[w.end - 1] == 6).astype(float)) / words]
    return np.stack(columns, 1)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.bincount(d[new], minlength=n)


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    count, different = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts = [x for x in t.split(b"\n") if x]
        count[i], different[i] = len(parts), len(set(parts))
    return count, different


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one double column per statistic."""
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.float64()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in K.blocks(rows.column(1)):
                yield K.batch(schema, rows.column(0).slice(a, b - a), *statistics_block(texts).T)
    return two(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray  # one column per fold left out, the last one fitted on all rows
    knots: np.ndarray
    values: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = self.map(x) @ self.weights[:, -1]
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", width: int = 256, ridge: float = 1e-3,
        seed: int = 11, max_fit: int = 200_000) -> Model:
    """Fit on the labelled rows of ``stats`` that are not held out."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y"))
             .where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y")))
    train = stats.join(marks.where(~held_out()), "doc_id")
    train = write(train.select("doc_id", "y", *FEATURES), "quality-train")
    moments = train.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in FEATURES
                                                   for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)),
                  rng.normal(size=(len(FEATURES), width)) / np.sqrt(len(FEATURES)) * 1.5,
                  rng.uniform(0, 2 * np.pi, width), np.zeros((width + 1, FOLDS + 1)), np.zeros(0), np.zeros(0))
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m_{c}"] for c in FEATURES])
    spread = np.array([moments[f"s_{c}"] for c in FEATURES])
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    share = min(1.0, max_fit / moments["n"])
    sample = (train.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
              .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int"))
              .coalesce(FIT_PARTITIONS))
    sums = _normal_equations(sample, model, width)
    total = sum(sums.values())
    for k in range(FOLDS + 1):
        part = total - sums[k] if k in sums and len(sums) > 1 else total
        gram, right = part[:, :-1], part[:, -1]
        rows = max(gram[-1, -1], 1.0)
        penalty = ridge * rows * np.eye(width + 1) / (width + 1)
        penalty[-1, -1] = 1e-9
        model.weights[:, k] = np.linalg.solve(gram + penalty, right)
    model.knots, model.values = _isotonic(_bins(sample, model))
    return model


def _normal_equations(sample: DataFrame, model: Model, width: int) -> dict[int, np.ndarray]:
    """Per fold the sums of z z' and z y, added up inside partitions and then by row block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns[3:]], 1)
            y, fold = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for k in np.unique(fold):
                z = model.map(x[fold == k])
                add = np.concatenate([z.T @ z, (z.T @ y[fold == k])[:, None]], 1)
                sums[int(k)] = sums.get(int(k), 0) + add
        for k, m in sums.items():
            for b, part in enumerate(np.array_split(m, BLOCKS)):
                yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int32()), "block": pa.array([b], pa.int32()),
                                                  "part": pa.array([part.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in group.column("part").to_pylist())
        return group.slice(0, 1).set_column(2, "part", pa.array([total.tobytes()], pa.binary()))
    kind = "fold int, block int, part binary"
    rows = (sample.select("doc_id", "y", "fold", *FEATURES).mapInArrow(run, kind)
            .groupBy("fold", "block").applyInArrow(add, kind).collect())
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.fold, r.block)):
        out.setdefault(r.fold, []).append(np.frombuffer(r.part).reshape(-1, width + 2))
    return {k: np.concatenate(v) for k, v in out.items()}


def _bins(sample: DataFrame, model: Model) -> np.ndarray:
    """Out-of-fold scores in ``BINS`` bins: mean score, rows, positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns[3:]], 1)
            fold = rows.column(2).to_numpy(zero_copy_only=False)
            raw = (model.map(x) * model.weights[:, fold].T).sum(1)
            yield pa.RecordBatch.from_pydict({"raw": raw, "y": rows.column(1)})
    rows = (sample.select("doc_id", "y", "fold", *FEATURES).mapInArrow(run, "raw double, y double")
            .withColumn("bin", F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)))
            .groupBy("bin").agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.sum("y").alias("hits")).collect())
    return np.array(sorted((r.raw, r.n, r.hits) for r in rows), dtype=np.float64)


def _isotonic(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the pooled mean scores."""
    stack: list[list[float]] = []
    for raw, n, hits in bins:
        stack.append([raw * n, n, hits])
        while len(stack) > 1 and stack[-2][2] / stack[-2][1] >= stack[-1][2] / stack[-1][1]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    pooled = np.array(stack)
    return pooled[:, 0] / pooled[:, 1], pooled[:, 2] / pooled[:, 1]


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    stats = write(statistics(docs), "quality-stats")
    model = fit(stats, labels, **settings)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns[1:]], 1)
            yield K.batch(schema, rows.column(0), model.score(x))
    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; the text is scored where it lies."""
    model = fit(write(statistics(docs), "quality-stats"), labels, **settings)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = [model.score(statistics_block(texts)) >= threshold for _, _, texts in K.blocks(rows.column(at))]
            yield rows.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
    return docs.mapInArrow(run, docs.schema)
