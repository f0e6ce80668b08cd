"""Boosted trees for all folds and labels of a run at once, with patience and a table of stored trees.

* **Fits.** Every (fold, label) is one group of all its training rows. Up to ``task_rows`` of them it grows its trees in one Spark task,
  from histograms of binned columns; the rows of larger groups are coded and summed up by blocks (``boosting_blocks``). A fit goes in
  blocks of rounds: the trees of a block of tasks are rows of a written table, so a lost executor repeats one block of one group.
  Only where ``most_rows`` is set, as a parameter search does, a fit takes a bounded, hashed sample of the rows.
* **Stages.** After a block, one pass over *all* validation rows of all folds sums the loss of every prefix of every
  ensemble (and, for a ranking head, histograms of its margins for the AUC). A group goes on until ``patience`` rounds have
  brought no better prefix or ``rounds`` are reached; its best prefix is kept.
* **Scores.** The kept trees are small and bounded (rounds x nodes), so tasks hold them and score rows where they are read.

Missing values go right at every split, as values beyond every threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import CLIP_HIGH, CLIP_LOW, SEED
from tidemark.sources.workspace import materialise

RANK_BINS, RANK_EVERY = 1024, 5
#: Rows that are scored at once.
_CHUNK = 1 << 15
#: Margins of the least and the largest probability.
_CLIPPED = np.log(CLIP_LOW / (1 - CLIP_LOW)), np.log(CLIP_HIGH / (1 - CLIP_HIGH))
#: A search fits many settings at once: group ``variant * VARIANT + fold`` is a fold under one of them.
VARIANT = 1000
_TREES = "fold int, label string, stage int, feature array<int>, threshold array<float>, value array<double>"
Key = tuple[int, str]


@dataclass(frozen=True)
class Booster:
    """Settings of a run; ``rate``, ``rounds`` and ``patience`` are the published ones."""

    name: str = "gbt"
    weight: str | None = None
    rounds: int = 1000
    patience: int = 50
    rate: float = 0.03
    depth: int = 5
    least: int = 30
    columns: float = 0.8
    rows: float = 0.8
    ridge: float = 1.0
    bins: int = 64
    block: int = 200
    #: Training rows that a fit takes at most, all without it; rows of a group that a task fits as they are, and bytes that it holds as codes.
    most_rows: int | None = None
    task_rows: int = 100_000
    block_bytes: int = 400 << 20
    by_auc: bool = False
    #: Positives weigh negatives / positives of the rows, as published for two of the stacked learners.
    balanced: bool = False
    seed: int = SEED

    def but(self, **changes) -> "Booster":
        return replace(self, **changes)


class Columns:
    """Rows of a block stored by columns, with room for the tests of a tree."""

    def __init__(self, x: np.ndarray):
        self.rows, self.values = len(x), np.ascontiguousarray(x.T)
        self.room: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, values: np.ndarray) -> "Columns":
        """Of values that are by columns already."""
        out = cls.__new__(cls)
        out.rows, out.values, out.room = values.shape[1], values, {}
        return out

    def tests(self, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """By test and row, whether the value is up to the threshold: a bit each."""
        n = len(feature)
        if n not in self.room:
            self.room[n] = np.empty((n, self.rows), self.values.dtype), np.empty((n, self.rows), bool)
        values, passed = self.room[n]
        np.take(self.values, feature, 0, values, "clip")
        np.less_equal(values, threshold[:, None], passed)
        return np.packbits(passed, axis=1)


@dataclass
class Tree:
    """A complete tree: ``feature`` and ``threshold`` of its inner nodes by level, ``value`` of its leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.value.take(self.leaves(Columns(x)))

    def leaves(self, block: Columns) -> np.ndarray:
        """The leaf of every row of a block.

        All tests are made on whole columns; the steps above a test then pick each row's own one, eight rows a byte.
        """
        place = np.zeros(block.rows, np.uint8 if len(self.value) <= 256 else np.int64)
        if not len(self.feature):
            return place
        tests, path, lo = block.tests(self.feature, self.threshold), [], 0
        while lo < len(tests):
            own = tests[lo:2 * lo + 1]
            for step in path:
                half = len(own) // 2
                own = own[half:] ^ ((own[:half] ^ own[half:]) & step)
            path.append(own[0])
            lo = 2 * lo + 1
        for left in np.unpackbits(np.stack(path), axis=1, count=block.rows):
            place += place
            place += left ^ 1
        return place


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Split points of each column: quantiles of its known values, none twice."""
    out = []
    for column in x.T:
        known = np.sort(column[~np.isnan(column)])
        at = np.unique(np.linspace(0, max(0, len(known) - 2), bins - 2).astype(np.int64)) if len(known) > 1 else np.zeros(0, np.int64)
        edges = np.unique(known[at])
        out.append(edges[edges < known[-1]] if len(known) else edges)
    return out


def _codes(x: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """Bin numbers, by columns."""
    codes = np.empty(x.T.shape, np.int32)
    for f, e in enumerate(edges):
        codes[f] = np.where(np.isnan(x[:, f]), bins - 1, np.searchsorted(e, x[:, f], side="left"))
    return codes


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _histograms(codes: np.ndarray, rows: np.ndarray | slice, slot: np.ndarray | None, slots: int, values: tuple[np.ndarray, ...], bins: int) -> np.ndarray:
    """Sums of the values and counts by slot, column and bin, over the given rows."""
    size, known = slots * bins, [v[rows] for v in values]
    at = None if slot is None else slot * bins
    out = np.empty((len(values) + 1, slots, len(codes), bins))
    for f, column in enumerate(codes):
        place = column[rows].astype(np.int64) if at is None else column[rows] + at
        for i, v in enumerate(known):
            out[i, :, f] = np.bincount(place, v, size).reshape(slots, bins)
        out[-1, :, f] = np.bincount(place, minlength=size).reshape(slots, bins)
    return out


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, s: Booster, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """One tree on a sample of rows and columns, and its value for every row."""
    width, n = codes.shape
    some = np.flatnonzero(rng.random(n) < s.rows) if s.rows < 1 else np.arange(n)
    if not len(some):
        some = np.arange(n)
    picked = np.sort(rng.choice(width, max(1, round(s.columns * width)), replace=False))
    k, bins = len(picked), s.bins
    own, sides = np.stack([codes[f].take(some) for f in picked]), (g[some], h[some])
    node, every = np.zeros(len(some), np.int64), np.zeros(n, np.int64)
    feature, threshold = [], []
    frozen, kept = np.zeros(1, bool), np.zeros(1)
    rows_all = np.arange(n)
    sums = _histograms(own, slice(None), None, 1, sides, bins)
    for level in range(s.depth):
        count = 1 << level
        if level:
            # Each node is summed up from its own rows, in their order: what is left of a parent would break ties by its rounding.
            going = np.flatnonzero(~frozen)
            slot = np.full(count, -1)
            slot[going] = np.arange(len(going))
            rows = np.flatnonzero(slot[node] >= 0)
            sums = np.zeros((3, count, k, bins))
            if len(going):
                sums[:, going] = _histograms(own, rows, slot[node[rows]], len(going), sides, bins)
        gl, hl, cl = (v.cumsum(2) for v in sums)
        gt, ht, ct = gl[:, :1, -1:], hl[:, :1, -1:], cl[:, :1, -1:]
        gr, hr, cr = gt - gl, ht - hl, ct - cl
        gain = gl * gl / (hl + s.ridge) + gr * gr / (hr + s.ridge) - gt * gt / (ht + s.ridge)
        gain = np.where((cl >= s.least) & (cr >= s.least), gain, -np.inf).reshape(count, -1)
        best = gain.argmax(1)
        now = ~frozen & ~(gain[np.arange(count), best] > 1e-9)
        kept = np.where(now, -gt[:, 0, 0] / (ht[:, 0, 0] + s.ridge), kept)
        frozen = frozen | now
        f, code = picked[best // bins], best % bins
        f, code = np.where(frozen, 0, f), np.where(frozen, bins, code)
        feature.append(f)
        threshold.append([np.inf if c >= len(edges[i]) else edges[i][c] for i, c in zip(f.tolist(), code.tolist(), strict=True)])
        every = 2 * every + (codes.ravel().take(f[every] * n + rows_all) > code[every])
        node = every[some]
        frozen, kept = np.repeat(frozen, 2), np.repeat(kept, 2)
    gs, hs = (np.bincount(node, weights=v, minlength=len(frozen)) for v in sides)
    value = s.rate * np.where(frozen, kept, -gs / (hs + s.ridge))
    # A frozen node sends known values left and missing ones right; both leaves have its value.
    tree = Tree(np.concatenate(feature).astype(np.int32), np.concatenate(threshold).astype(np.float32), value)
    return tree, value[every]


def _total(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Sums of the trees' values, a chunk of rows at a time."""
    out = np.zeros(len(x))
    for lo in range(0, len(x), _CHUNK):
        block = Columns(x[lo:lo + _CHUNK])
        for tree in trees:
            out[lo:lo + _CHUNK] += tree.value.take(tree.leaves(block))
    return out


def grow_block(x: np.ndarray, y: np.ndarray, w: np.ndarray, before: list[Tree], s: Booster, seed: int, rounds: int) -> list[Tree]:
    """The next trees of an ensemble; the first one ever is the constant."""
    x = x.astype(np.float32)
    if s.balanced:
        positive = min(max(float((w * y).sum() / max(w.sum(), 1e-12)), 1e-6), 1 - 1e-6)
        w = np.where(y > 0, w * (1 - positive) / positive, w)
    out = []
    if not before:
        share = min(max(float((w * y).sum() / max(w.sum(), 1e-12)), 1e-6), 1 - 1e-6)
        out.append(Tree(np.zeros(0, np.int32), np.zeros(0, np.float32), np.array([np.log(share / (1 - share))])))
    margin = _total([*before, *out], x)
    edges = _edges(x, s.bins)
    codes = _codes(x, edges, s.bins)
    first = max(1, len(before))
    for stage in range(first, first + rounds):
        p = sigmoid(margin)
        tree, more = _grow(codes, edges, w * (p - y), w * p * (1 - p), s, np.random.default_rng([seed, stage]))
        out.append(tree)
        margin = margin + more
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together: what a tree costs beside its rows is paid once for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _CHUNK:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Fold and features of the rows of each fold in a batch."""
    for batch in _gathered(batches):
        folds, x = batch.column("fold").to_numpy(), _matrix(batch.column("x")).astype(np.float32, copy=False)
        for fold in np.unique(folds).tolist():
            yield fold, x[folds == fold]


def vector(features: list[str]) -> Column:
    """Feature columns as one array; missing values are not a number."""
    return F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(float("nan")).cast("float")) for f in features])


def _drawn(labels: list[str], s: Booster, sizes: dict[int, int]) -> Column:
    """Whether a training row is in the hashed sample that a fit takes: all rows of a fold, or some ``most_rows`` of them. Drawn rows
    are all drawn again."""
    if s.most_rows is None:
        return F.lit(True)
    share = F.lit(1.0)
    for fold, n in sizes.items():
        share = F.when(F.col("fold") == fold, min(1.0, s.most_rows / n) if n else 1.0).otherwise(share)
    return F.pmod(F.xxhash64("x", "w", *[f"y_{y}" for y in labels], F.lit(s.seed)), F.lit(1 << 30)) < share * (1 << 30)


def table(frames: list[tuple[int, DataFrame]], features: dict[int, list[str]], labels: list[str], keep: list[str], weight: str | None = None,
          roles: list[str] | None = None, sample: Booster | None = None, sizes: dict[int, int] | None = None) -> DataFrame:
    """Rows of all folds in one written table: ``fold, role, x, w``, the labels as doubles (``y_<label>``) and ``keep``.

    ``roles`` names the roles to write, all without it. With ``sample`` only those training rows are written that a fit under
    these settings and labels draws; rows in other roles are all written. ``sizes`` are the training rows of folds where they are known.
    """
    out = None
    for number, rows in frames:
        x = vector(features[number])
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        if roles is not None:
            rows = rows.where(F.col("role").isin(*roles))
        part = rows.select(F.lit(number).alias("fold"), F.col("role"), x.alias("x"), w.alias("w"),
                           *[F.col(y).cast("double").alias(f"y_{y}") for y in labels], *keep)
        if sample and sample.most_rows is not None:
            n = sizes[number] if sizes and number in sizes else rows.where("role = 'train'").count()
            part = part.where((F.col("role") != "train") | _drawn(labels, sample, {number: n}))
        out = part if out is None else out.unionByName(part)
    return materialise(out, "boosting")


def _collected(trees: DataFrame) -> dict[Key, list[Tree]]:
    """Stored trees by (fold, label), in the order of their stages. Their number is bounded by rounds, folds and labels."""
    held: dict[Key, dict[int, Tree]] = {}
    found = trees.toArrow()
    for fold, label, stage, f, t, v in zip(*(found.column(c).to_pylist() for c in ("fold", "label", "stage", "feature", "threshold", "value")), strict=True):
        held.setdefault((fold, label), {})[stage] = Tree(np.array(f, np.int32), np.array(t, np.float32), np.array(v))
    return {k: [v[i] for i in sorted(v)] for k, v in held.items()}


def _grown(rows: DataFrame, labels: list[str], wanted: list[Key], before: dict[Key, list[Tree]], settings: dict[int, Booster], rounds: int) -> DataFrame:
    """The next block of trees of the wanted groups, fitted on the drawn rows, as a written table."""
    sides = F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"y_{y}").alias("y")) for y in labels])
    long = rows.select("fold", "x", "w", F.inline(sides)).where("y is not null")
    groups: dict[Key, list[int]] = {}
    for group, label in wanted:
        groups.setdefault((group % VARIANT, label), []).append(group)
    asked = F.lit(None).cast("array<int>")
    for (fold, label), numbers in groups.items():
        asked = F.when((F.col("fold") == fold) & (F.col("label") == label), F.array(*map(F.lit, numbers))).otherwise(asked)
    long = long.select(F.explode(asked).alias("fold"), "label", "x", "w", "y")

    def fit(group: pa.Table) -> pa.Table:
        key = group.column("fold")[0].as_py(), group.column("label")[0].as_py()
        x, y, w = _matrix(group.column("x")), group.column("y").to_numpy(), group.column("w").to_numpy()
        # Rows come in any order: the fit must not depend on it.
        by = np.lexsort((*x.T[::-1], w, y))
        own = settings[key[0] // VARIANT]
        done = before.get(key, [])
        made = grow_block(x[by], y[by], w[by], done, own, own.seed, min(rounds, own.rounds - max(0, len(done) - 1)))
        at = range(len(done), len(done) + len(made))
        return pa.table({"fold": pa.array([key[0]] * len(made), pa.int32()), "label": [key[1]] * len(made), "stage": pa.array(list(at), pa.int32()),
                         "feature": pa.array([t.feature.tolist() for t in made], pa.list_(pa.int32())),
                         "threshold": pa.array([t.threshold.tolist() for t in made], pa.list_(pa.float32())),
                         "value": pa.array([t.value.tolist() for t in made], pa.list_(pa.float64()))})
    return materialise(long.groupBy("fold", "label").applyInArrow(fit, _TREES), "trees")


def stage_losses(rows: DataFrame, trees: dict[Key, list[Tree]], ranks: bool = False) -> dict[Key, np.ndarray]:
    """Of every (fold, label): the mean log-loss of each prefix on the given rows, or one less the AUC every few stages."""
    schema = "fold int, label string, stage int, bin int, n double, v double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Key, np.ndarray] = {}
        for batch in _gathered(batches):
            folds, x = batch.column("fold").to_numpy(), _matrix(batch.column("x"))
            for fold in np.unique(folds).tolist():
                every = np.flatnonzero(folds == fold)
                whole = None
                for (group, label), held in trees.items():
                    if group % VARIANT != fold:
                        continue
                    y = batch.column(f"y_{label}").to_numpy(zero_copy_only=False)
                    some = every[~np.isnan(y[every])]
                    if not len(some):
                        continue
                    if len(some) < len(every):
                        block = Columns(x[some])
                    else:
                        block = whole = whole or Columns(x[every])
                    ys, margin = y[some], np.zeros(len(some))
                    shape = (len(held), 2, RANK_BINS) if ranks else (len(held), 2, 1)
                    out = total.setdefault((group, label), np.zeros(shape))
                    odds = np.ones(len(some))
                    for k, tree in enumerate(held):
                        leaf = tree.leaves(block)
                        margin += tree.value.take(leaf)
                        if not ranks:
                            # The log-loss of a clipped probability is log(1 + odds) - y * margin; a logarithm of 64 factors does for 64 rows.
                            odds *= np.exp(tree.value).take(leaf)
                            factors = 1 + np.clip(odds, *np.exp(_CLIPPED))
                            out[k, 0, 0] += len(ys)
                            out[k, 1, 0] += float(np.log(np.multiply.reduceat(factors, np.arange(0, len(ys), 64))).sum() - ys @ np.clip(margin, *_CLIPPED))
                        elif k % RANK_EVERY == 0:
                            at = np.clip((margin + 8) * (RANK_BINS / 16), 0, RANK_BINS - 1).astype(np.int64)
                            out[k, 0] += np.bincount(at, minlength=RANK_BINS)
                            out[k, 1] += np.bincount(at, weights=ys, minlength=RANK_BINS)
        for (fold, label), out in total.items():
            stage, at = np.nonzero(out[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(stage), fold, np.int32)), pa.array([label] * len(stage), pa.string()), pa.array(stage.astype(np.int32)),
                 pa.array(at.astype(np.int32)), pa.array(out[stage, 0, at]), pa.array(out[stage, 1, at])], names=["fold", "label", "stage", "bin", "n", "v"])
    names = ["fold", "x", *dict.fromkeys(f"y_{label}" for _, label in trees)]
    parts = rows.select(*names).mapInArrow(sums, schema).groupBy("fold", "label", "stage", "bin").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    if ranks:
        # Pairs that a stage orders rightly; rows of one bin tie and count half.
        below = F.coalesce(F.sum(F.col("n") - F.col("v")).over(Window.partitionBy("fold", "label", "stage").orderBy("bin").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0.0))
        pairs = F.sum(F.col("v") * (F.col("below") + 0.5 * (F.col("n") - F.col("v"))))
        both = F.sum("v") * F.sum(F.col("n") - F.col("v"))
        loss = F.when(both > 0, 1 - pairs / both).otherwise(0.5)
        parts = parts.withColumn("below", below).groupBy("fold", "label", "stage").agg(loss.alias("loss"))
    else:
        parts = parts.select("fold", "label", "stage", (F.col("v") / F.col("n")).alias("loss"))
    out = {k: np.full(len(v), np.inf) for k, v in trees.items()}
    for r in parts.collect():
        out[r["fold"], r["label"]][r["stage"]] = r["loss"]
    return out


@dataclass
class Fitted:
    """Kept trees of a run by (fold, label), and the report: rounds grown, best stage and its loss."""

    trees: dict[Key, list[Tree]]
    report: list[tuple[int, str, int, int, float]]


def fit(rows: DataFrame, labels: list[str], s: Booster, validate: bool = True, rounds: dict[Key, int] | None = None,
        variants: list[Booster] | None = None) -> Fitted:
    """Fits every fold and label of ``rows`` (made by ``table``).

    Without ``validate`` all rounds are kept, ``rounds`` of each (fold, label) or those of the settings. ``variants``
    are settings that compete: all are fitted in the same jobs, and after each block the worse half of those still
    going, by the mean loss of their best prefixes, stops growing (successive halving).
    """
    from tidemark.operators import boosting_blocks  # which takes trees and settings from here
    settings = dict(enumerate(variants)) if variants else {0: s}
    if rounds:
        settings = {0: s.but(rounds=max(rounds.values()))}
    train, val = rows.where("role = 'train'"), rows.where("role = 'val'")
    sizes = {r["fold"]: r["n"] for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, most = train.where(_drawn(labels, settings[0], sizes)).select("fold", "x", "w", *[f"y_{y}" for y in labels]), settings[0].most_rows
    if most is not None and any(n > most for n in sizes.values()):
        # Written once, so that a block of rounds does not read all training rows again.
        drawn = materialise(drawn, "drawn")
        sizes = {r["fold"]: r["n"] for r in drawn.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {f: n for f, n in sizes.items() if n > settings[0].task_rows}
    coded = boosting_blocks.Coded(drawn.where(F.col("fold").isin(list(large))), large, labels, settings[0]) if large else None
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    going = [(v * VARIANT + f, y) for v in settings for f in folds for y in labels]
    trees: dict[Key, list[Tree]] = {}
    losses: dict[Key, np.ndarray] = {}
    while going:
        small, more = [k for k in going if k[0] % VARIANT not in large], {}
        if small:
            more |= _collected(_grown(drawn, labels, small, trees, settings, s.block))
        if coded and len(small) < len(going):
            more |= coded.grow([k for k in going if k[0] % VARIANT in large], settings, s.block)
        for key, made in more.items():
            trees[key] = trees.get(key, []) + made
        missing = [k for k in going if k not in trees]
        if missing:
            raise ValueError(f"no training rows for {missing}")
        if validate:
            losses |= stage_losses(val, {k: trees[k] for k in going}, s.by_auc)
        going = [k for k in going if len(trees[k]) <= settings[k[0] // VARIANT].rounds
                 and (not validate or len(trees[k]) - 1 - int(losses[k].argmin()) < settings[k[0] // VARIANT].patience)]
        if variants:
            mean = {v: np.mean([losses[k].min() for k in losses if k[0] // VARIANT == v]) for v in settings}
            order = sorted({k[0] // VARIANT for k in going}, key=lambda v: (mean[v], v))
            stay = set(order[:-(-len(order) // 2)]) if len(order) > 1 else set(order)
            going = [k for k in going if k[0] // VARIANT in stay]
    report = []
    for key in sorted(trees):
        grown = len(trees[key]) - 1
        best = int(losses[key].argmin()) if validate else min(grown, (rounds or {}).get(key, grown))
        report.append((*key, grown, best, float(losses[key][best]) if validate else float("nan")))
        trees[key] = trees[key][:best + 1]
    return Fitted(trees, report)


def stored(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """The kept trees as rows, with the number of rounds that were grown and the loss of the kept prefix."""
    found = {(f, y): (grown, loss) for f, y, grown, _, loss in fitted.report}
    rows = [(f, y, stage, t.feature.tolist(), t.threshold.tolist(), t.value.tolist(), *found[f, y])
            for (f, y), trees in sorted(fitted.trees.items()) for stage, t in enumerate(trees)]
    return spark.createDataFrame(rows, f"{_TREES}, grown int, loss double")


def load(trees: DataFrame) -> Fitted:
    return Fitted(_collected(trees), [])


def score_variants(rows: DataFrame, fitted: Fitted, label: str, out: str, keep: list[str]) -> DataFrame:
    """``variant``, ``fold``, ``keep`` and the probability ``out`` of each row under the trees of every variant of its fold."""
    variants = sorted({f // VARIANT for f, y in fitted.trees if y == label})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            folds, x = batch.column("fold").to_numpy(), _matrix(batch.column("x"))
            for v in variants:
                p = np.full(len(folds), np.nan)
                for fold in np.unique(folds).tolist():
                    some = np.flatnonzero(folds == fold)
                    p[some] = sigmoid(_total(fitted.trees[v * VARIANT + fold, label], x[some]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(folds), v, np.int32)), *(batch.column(c) for c in ("fold", *keep)),
                                                  pa.array(np.clip(p, CLIP_LOW, CLIP_HIGH))], names=["variant", "fold", *keep, out])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["variant int", *(f"`{c}` {kinds[c]}" for c in ("fold", *keep)), f"`{out}` double"])
    return rows.select("fold", "x", *keep).mapInArrow(run, schema)


def score(rows: DataFrame, fitted: Fitted, scores: dict[str, str], keep: list[str]) -> DataFrame:
    """``fold``, ``keep`` and, by label, the clipped probabilities of each row under its fold's trees."""
    names = ["fold", *keep, *scores.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            folds, x = batch.column("fold").to_numpy(), _matrix(batch.column("x"))
            made = []
            for label in scores:
                p = np.full(len(folds), np.nan)
                for fold in np.unique(folds).tolist():
                    some = np.flatnonzero(folds == fold)
                    p[some] = sigmoid(_total(fitted.trees[fold, label], x[some]))
                made.append(pa.array(np.clip(p, CLIP_LOW, CLIP_HIGH)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("fold", *keep)] + made, names=names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("fold", *keep)] + [f"`{p}` double" for p in scores.values()])
    return rows.select("fold", "x", *keep).mapInArrow(run, schema)

