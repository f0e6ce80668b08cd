"""A small network with three hazard heads, fitted for all folds at once by partition-summed gradients.

One pass over the rows gives, per fold, the exact gradient of the weighted loss over the training rows and histograms of the
validation rows' cumulative scores under the weights at hand; partial sums have the size of the weights, whatever the
number of rows. The driver holds weights only and makes an Adam step per pass. A fold stops when its weighted score has not risen for
``patience`` steps and keeps its best weights. Rare intervals weigh more in the loss (negatives per positive, capped); no row
is copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CLIP_HIGH, CLIP_LOW, MAX_CLASS_WEIGHT, SEED
from tidemark.operators.blending import BINS, histogram, share
from tidemark.sources.workspace import materialise

# Published layers, weight decay, patience, least gain and weights of the interval losses.
HIDDEN, DECAY, PATIENCE, LEAST_GAIN = (128, 64), 1e-4, 15, 1e-4
INTERVAL_WEIGHTS = np.array([0.8, 0.1, 0.1])
#: Rows of a packed record, and rows that go through the layers at once, so that these stay in a core's cache.
_RECORD, _CHUNK = 64, 512


@dataclass
class Network:
    """Layers ``(weights, offsets)`` with rectified linear units between them."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def start(cls, width: int, hidden: tuple[int, ...], seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        sizes = [width, *hidden, 3]
        return cls([(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def like(self, flat: np.ndarray) -> "Network":
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at:at + w.size].reshape(w.shape), flat[at + w.size:at + w.size + b.size]))
            at += w.size + b.size
        return Network(out)

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The heads' log-odds, and the inputs of each layer."""
        seen = [x]
        for i, (w, b) in enumerate(self.layers):
            x = x @ w
            x += b
            if i + 1 < len(self.layers):
                np.maximum(x, 0, out=x)
                seen.append(x)
        return x, seen

    def gradient(self, x: np.ndarray, z: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss of the rows and its gradient; ``weights`` are those of the positives of each head."""
        out, seen = self.logits(x)
        p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
        q = np.clip(p, 1e-12, 1 - 1e-12)
        loss = -(INTERVAL_WEIGHTS * (weights * z * np.log(q) + (1 - z) * np.log(1 - q))).sum() / 3
        back = INTERVAL_WEIGHTS * (weights * z * (p - 1) + (1 - z) * p) / 3
        parts: list[np.ndarray] = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts[:0] = [(seen[i].T @ back).ravel(), back.sum(0)]
            if i:
                back = back @ self.layers[i][0].T
                back *= seen[i] > 0
        return float(loss), np.concatenate(parts)

    def cumulative(self, x: np.ndarray) -> np.ndarray:
        """Nested scores: the hazards multiply up."""
        h = 1 / (1 + np.exp(-np.clip(self.logits(x)[0], -40, 40)))
        return np.clip(1 - np.cumprod(1 - h, axis=1), CLIP_LOW, CLIP_HIGH)


def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(rows: DataFrame) -> DataFrame:
    """``fold, train, x, y`` with up to ``_RECORD`` rows of one fold and side a record, their numbers as bytes.

    Passes read the rows many times; as bytes they reach the tasks without being taken apart and put together by value.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, train = batch.column("fold").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            x, y = _block(batch.column("x")).astype(float), _block(batch.column("y")).astype(float)
            for f in np.unique(fold).tolist():
                for side in (True, False):
                    some = np.flatnonzero((fold == f) & (train == side))
                    cuts = [some[lo:lo + _RECORD] for lo in range(0, len(some), _RECORD)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(cuts), pa.int64()), pa.array([side] * len(cuts), pa.bool_()),
                         pa.array([x[c].tobytes() for c in cuts], pa.binary()), pa.array([y[c].tobytes() for c in cuts], pa.binary())],
                        names=["fold", "train", "x", "y"])
    return rows.select("fold", "train", "x", "y").mapInArrow(pack, "fold long, train boolean, x binary, y binary")


def _numbers(column: pa.Array) -> np.ndarray:
    """The numbers of neighbouring records, which lie side by side in their batch."""
    at = np.frombuffer(column.buffers()[1], np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[column.offset]:at[column.offset + len(column)]].view(float)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Fold, side, x and y of the rows of neighbouring records with one fold and side."""
    fold, train = batch.column("fold").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(fold) != 0) | (train[1:] != train[:-1])) + 1).tolist(), len(fold)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo < hi:
            x, y = (_numbers(batch.column(c).slice(lo, hi - lo)) for c in ("x", "y"))
            n = len(y) // 3
            yield int(fold[lo]), bool(train[lo]), x.reshape(n, -1), y.reshape(n, 3)


def _pass(rows: DataFrame, nets: dict[int, Network], weights: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold: loss, rows and gradient of the training rows in one vector, and the histogram of the validation rows.

    ``rows`` may be packed.
    """
    size = {f: n.flat().size + 2 for f, n in nets.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(size[f] + 3 * (2 * BINS + 1)) for f in nets}
        for batch in batches:
            for f, train, x, y in _runs(batch):
                out, net = total[f], nets[f]
                if not train:
                    p = np.concatenate([net.cumulative(x[lo:lo + _CHUNK]) for lo in range(0, len(x), _CHUNK)])
                    out[size[f]:] += histogram(p, y).ravel()
                    continue
                z = np.diff(y, axis=1, prepend=0)
                for lo in range(0, len(x), _CHUNK):
                    loss, g = net.gradient(x[lo:lo + _CHUNK], z[lo:lo + _CHUNK], weights[f])
                    out[0] += loss
                    out[2:size[f]] += g
                out[1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["f", "t"])

    def add(group: pa.Table) -> pa.Table:
        out = 0
        for t in group.column("t").to_pylist():
            out = out + np.frombuffer(t)
        return pa.table({"f": group.column("f").slice(0, 1), "t": pa.array([out.tobytes()], pa.binary())})
    blocks = rows if dict(rows.dtypes)["x"] == "binary" else packed(rows)
    parts = blocks.where(F.col("fold").isin(list(nets))).mapInArrow(sums, "f long, t binary").withColumn("salt", F.spark_partition_id() % 32)
    # Partial sums have one size; the salt bounds how many meet in a task.
    parts = parts.groupBy("f", "salt").applyInArrow(add, "f long, t binary").groupBy("f").applyInArrow(add, "f long, t binary")
    out = {}
    for r in parts.collect():
        t = np.frombuffer(r["t"])
        out[r["f"]] = t[:size[r["f"]]], t[size[r["f"]]:].reshape(3, -1)
    return out


def fit(rows: DataFrame, hidden: tuple[int, ...] = HIDDEN, rate: float = 5e-3, steps: int = 120, patience: int = PATIENCE, seed: int = SEED
        ) -> tuple[dict[int, Network], list[tuple[int, int, int, float]]]:
    """Networks by fold of the rows ``fold, train, x, y`` (nested labels), and ``(fold, steps, best step, best score)`` of each."""
    counts = rows.where("train").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y")[0]).alias("a"), F.sum(F.col("y")[1]).alias("b"),
                                                     F.sum(F.col("y")[2]).alias("c"), F.max(F.size("x")).alias("width")).collect()
    weights, nets = {}, {}
    for r in counts:
        pos = np.diff([0.0, r["a"], r["b"], r["c"]])
        weights[r["fold"]] = np.where(pos > 0, np.clip((r["n"] - pos) / np.maximum(pos, 1), 1, MAX_CLASS_WEIGHT), 1.0)
        nets[r["fold"]] = Network.start(r["width"], hidden, seed)
    rows = materialise(packed(rows), "packed")
    flat = {f: n.flat() for f, n in nets.items()}
    first, second = {f: np.zeros_like(v) for f, v in flat.items()}, {f: np.zeros_like(v) for f, v in flat.items()}
    best = {f: (-np.inf, 0, nets[f]) for f in nets}
    ended: dict[int, int] = {}
    for step in range(1, steps + 2):
        going = {f: nets[f] for f in nets if f not in ended}
        if not going:
            break
        for f, (sums, hist) in _pass(rows, going, weights).items():
            score = share(hist)
            if score > best[f][0] + LEAST_GAIN:
                best[f] = score, step - 1, nets[f]
            if step - 1 - best[f][1] >= patience or step > steps:
                ended[f] = step - 1
                continue
            g = sums[2:] / max(sums[1], 1) + DECAY * flat[f]
            first[f] = 0.9 * first[f] + 0.1 * g
            second[f] = 0.999 * second[f] + 0.001 * g * g
            move = (first[f] / (1 - 0.9 ** step)) / (np.sqrt(second[f] / (1 - 0.999 ** step)) + 1e-8)
            flat[f] = flat[f] - rate * move
            nets[f] = nets[f].like(flat[f])
    return {f: b[2] for f, b in best.items()}, [(f, ended.get(f, steps), b[1], b[0]) for f, b in sorted(best.items())]


def score(rows: DataFrame, nets: dict[int, Network], out: list[str], keep: list[str]) -> DataFrame:
    """``fold``, ``keep`` and the nested scores of each row under its fold's network."""
    names = ["fold", *keep, *out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = batch.column("fold").to_numpy(), _block(batch.column("x")).astype(float)
            p = np.zeros((len(fold), 3))
            for f in np.unique(fold).tolist():
                some = np.flatnonzero(fold == f)
                for lo in range(0, len(some), _CHUNK):
                    at = some[lo:lo + _CHUNK]
                    p[at] = nets[f].cumulative(x[at])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fold", *keep)] + [pa.array(np.ascontiguousarray(c)) for c in p.T], names=names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("fold", *keep)] + [f"`{p}` double" for p in out])
    return rows.select("fold", "x", *keep).mapInArrow(run, schema)
