"""Trees of groups that are too large to be fitted from their rows at once: all training rows, as blocks of coded columns.

* **Codes.** Split points are exact order statistics of all known values of a fold's column, found by two counting passes over the two halves
  of their bits. Rows are then coded (a byte a column), put in an order of their own, and written as records of some thousand rows.
* **Sums.** Gradients are rounded to a unit at which their sums over the whole group are whole numbers below 2^53. Sums are then the same in
  any order and however the rows are spread, and of two sibling nodes only the lesser is summed up; the other is what is left of its parent.
  Columns of few codes are counted together, as digits of one number.
* **Where.** Groups whose coded rows take at most ``Booster.block_bytes`` grow in one task each, which holds them. Of larger ones a level of the trees of all
  groups is one pass over the records; partial sums have the size of the trees, whatever the number of rows. The margins that the trees
  have given to the rows so far are written anew every few trees, so that a pass applies the latest ones only.

Rows of a tree are drawn by their place in the order, so a fit depends neither on the order of its input nor on how it is spread.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.boosting import VARIANT, Booster, Columns, Key, Tree, sigmoid, vectors_of
from tidemark.sources.workspace import discard, materialise

#: Rows of a written record, and rows that are worked on at once.
_RECORD, _STEP = 1 << 14, 1 << 17
#: Codes of columns that are counted together, trees between two writings of the margins, and records of a written file.
_PACK, _PENDING, _FILE = 4096, 4, 32
#: Partial sums that one task adds up.
_FAN = 32


# ---------------------------------------------------------------- split points

def _ordered(x: np.ndarray) -> np.ndarray:
    """The bits of numbers as whole numbers of the same order."""
    bits = (x + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def _number(key: int) -> np.float32:
    bits = np.uint32(key & 0x7FFFFFFF if key >> 31 else ~key & 0xFFFFFFFF)
    return bits.view(np.float32)


def _wanted(known: int, bins: int) -> np.ndarray:
    """The places of the split points among sorted known values, and the last place."""
    if known < 2:
        return np.arange(known)
    return np.append(np.unique(np.linspace(0, max(0, known - 2), bins - 2).astype(np.int64)), known - 1)


def exact_edges(rows: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """By fold, the split points of each column: quantiles of all its known values, none twice."""
    counts = "fold int, col int, at int, n long"

    def sparse(fold: int, col: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, fold, np.int32)), pa.array(np.full(size, col, np.int32)), pa.array(at.astype(np.int32)),
                                           pa.array(n.astype(np.int64))], names=["fold", "col", "at", "n"])

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for fold, x in vectors_of(batches):
            held = total.setdefault(fold, np.zeros((x.shape[1], 1 << 16), np.int64))
            for c in range(x.shape[1]):
                v = x[:, c]
                held[c] += np.bincount(_ordered(v[~np.isnan(v)]) >> 16, minlength=1 << 16)
        for fold, held in total.items():
            for c, n in enumerate(held):
                yield sparse(fold, c, np.flatnonzero(n), n[n > 0])

    def placed(group: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
        at, n = group.column("at").to_numpy(), group.column("n").to_numpy()
        by = np.argsort(at)
        return group.column("fold")[0].as_py(), group.column("col")[0].as_py(), at[by], n[by].cumsum()

    def buckets(group: pa.Table) -> pa.Table:
        fold, col, at, upto = placed(group)
        places = _wanted(int(upto[-1]), bins)
        own = np.searchsorted(upto, places, side="right")
        left = places - np.where(own > 0, upto[own - 1], 0)
        return pa.table({"fold": pa.array([fold], pa.int32()), "col": pa.array([col], pa.int32()), "at": pa.array([at[own].tolist()], pa.list_(pa.int32())),
                         "place": pa.array([left.tolist()], pa.list_(pa.int64()))})
    rows = rows.select("fold", "x")
    summed = rows.mapInArrow(high, counts).groupBy("fold", "col", "at").agg(F.sum("n").alias("n"))
    found = summed.groupBy("fold", "col").applyInArrow(buckets, "fold int, col int, at array<int>, place array<long>").collect()
    asked = {(r["fold"], r["col"]): (np.array(r["at"], np.int64), np.array(r["place"], np.int64)) for r in found}
    own = {k: np.unique(at) for k, (at, _) in asked.items()}

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, x in vectors_of(batches):
            for c in range(x.shape[1]):
                if (fold, c) not in own:
                    continue
                v, mine = x[:, c], own[fold, c]
                key = _ordered(v[~np.isnan(v)])
                at = np.minimum(np.searchsorted(mine, key >> 16), len(mine) - 1)
                key, at = (a[mine[at] == key >> 16] for a in (key, at))
                if len(key):
                    yield sparse(fold, c, *np.unique(at << 16 | (key & 0xFFFF), return_counts=True))

    def values(group: pa.Table) -> pa.Table:
        fold, col, at, upto = placed(group)
        at, (high_at, place) = at.astype(np.int64), asked[fold, col]
        bucket = np.searchsorted(own[fold, col], high_at)
        first = np.searchsorted(at, bucket << 16)
        before = np.where(first > 0, upto[first - 1], 0)
        hit = at[np.searchsorted(upto, before + place, side="right")]
        out = [float(_number(int(h) << 16 | int(k) & 0xFFFF)) for h, k in zip(high_at, hit, strict=True)]
        return pa.table({"fold": pa.array([fold], pa.int32()), "col": pa.array([col], pa.int32()), "v": pa.array([out], pa.list_(pa.float32()))})
    summed = rows.mapInArrow(low, counts).groupBy("fold", "col", "at").agg(F.sum("n").alias("n"))
    points = {(r["fold"], r["col"]): np.array(r["v"], np.float32)
              for r in summed.groupBy("fold", "col").applyInArrow(values, "fold int, col int, v array<float>").collect()}
    widths = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.max(F.size("x")).alias("n")).collect()}

    def edges(key: Key) -> np.ndarray:
        v = points.get(key, np.zeros(0, np.float32))
        return np.unique(v[:-1][v[:-1] < v[-1]]) if len(v) else v
    return {f: [edges((f, c)) for c in range(n)] for f, n in widths.items()}


# ---------------------------------------------------------------- coded rows

class Shape:
    """How the columns of a fold are coded: 0 up to the number of split points, and one more for missing values."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.codes = edges, np.array([len(e) + 2 for e in edges])
        self.kind = np.uint8 if self.codes.max() <= 255 else np.uint16
        #: What no code exceeds: all rows go left.
        self.all_left = np.iinfo(self.kind).max
        self.packs: list[list[int]] = []
        sizes: list[int] = []
        for c in np.argsort(-self.codes, kind="stable").tolist():
            fits = [i for i, n in enumerate(sizes) if n * self.codes[c] <= _PACK]
            if not fits:
                fits = [len(sizes)]
                sizes.append(1)
                self.packs.append([])
            self.packs[fits[0]].append(c)
            sizes[fits[0]] *= int(self.codes[c])

    @property
    def row_bytes(self) -> int:
        """What a task holds of a row: its codes, alone and counted together, label, weight, margin, place and gradients."""
        return len(self.edges) * np.dtype(self.kind).itemsize + 2 * len(self.packs) + 48

    def coded(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, self.kind)
        for f, e in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), len(e) + 1, np.searchsorted(e, x[:, f], side="left"))
        return out

    def threshold(self, feature: int, code: int) -> float:
        return float(self.edges[feature][code]) if code < len(self.edges[feature]) else np.inf


class Block:
    """Coded rows of one fold in a task; ``runs`` are the places in the fold's order that they take: first ones and lengths."""

    def __init__(self, shape: Shape, codes: np.ndarray, runs: list[tuple[int, int]], w: np.ndarray):
        self.shape, self.runs, self.w, self.columns = shape, runs, w, Columns.of(codes)
        self.numbers: dict[int, np.ndarray] = {}

    def drawn(self, s: Booster, stage: int) -> np.ndarray:
        """Whether a tree takes a row: by its place."""
        out = []
        for start, n in self.runs:
            bits = np.random.PCG64([s.seed, stage])
            bits.advance(start)
            out.append(np.random.Generator(bits).random(n) < s.rows)
        return np.concatenate(out)

    def margin(self, trees: list[Tree], before: np.ndarray | None = None) -> np.ndarray:
        """The margins of the rows under some more trees."""
        out = np.zeros(self.columns.rows) if before is None else before.copy()
        for tree in trees:
            out += tree.value.take(tree.leaves(self.columns))
        return out

    def number(self, pack: int) -> np.ndarray:
        """The codes of a pack's columns as digits of one number."""
        if pack not in self.numbers:
            out = np.zeros(self.columns.rows, np.int32)
            for c in self.shape.packs[pack]:
                out *= self.shape.codes[c]
                out += self.columns.values[c]
            self.numbers[pack] = out.astype(np.uint16) if np.prod(self.shape.codes[self.shape.packs[pack]]) <= 1 << 16 else out
        return self.numbers[pack]

    def sums(self, ask: "Ask", rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of the values and counts by asked node and code of the picked columns, over the given rows."""
        shape, slots = self.shape, len(ask.nodes)
        slot = None
        if ask.tree is not None:
            of = np.full(len(ask.tree.value), -1, np.int64)
            of[ask.nodes] = np.arange(slots)
            slot = of.take(ask.tree.leaves(self.columns).take(rows))
            some = np.flatnonzero(slot >= 0)
            rows, slot = rows.take(some), slot.take(some)
        values = [g.take(rows), h.take(rows), None]
        first = dict(zip(ask.picked.tolist(), np.cumsum([0, *shape.codes[ask.picked]]).tolist()))
        out = np.zeros((3, slots, int(shape.codes[ask.picked].sum())))
        for i, pack in enumerate(shape.packs):
            if not any(c in first for c in pack):
                continue
            digits = shape.codes[pack].tolist()
            size = int(np.prod(digits))
            place = self.number(i).take(rows).astype(np.int64)
            if slot is not None and slots > 1:
                place += slot * size
            for j, v in enumerate(values):
                total = (np.bincount(place, v, slots * size) if v is not None else np.bincount(place, minlength=slots * size)).reshape(slots, *digits)
                for axis, c in enumerate(pack, 1):
                    if c in first:
                        rest = tuple(a for a in range(1, len(pack) + 1) if a != axis)
                        out[j, :, first[c]:first[c] + digits[axis - 1]] = total.sum(rest)
        return out


# ---------------------------------------------------------------- growing a tree from sums

@dataclass
class Ask:
    """A question of a tree that grows: the sums of some nodes at the bottom of ``tree`` (none: the root), over the picked columns."""

    picked: np.ndarray
    tree: Tree | None
    nodes: np.ndarray


def growing(shape: Shape, s: Booster, stage: int, unit: float) -> Generator[Ask, np.ndarray, tuple[Tree, Tree]]:
    """Grows a tree from the sums it asks for; the same tree over values and over codes."""
    width = len(shape.edges)
    picked = np.sort(np.random.default_rng([s.seed, stage, 1]).choice(width, max(1, round(s.columns * width)), replace=False))
    codes = shape.codes[picked]
    k, bins = len(picked), int(codes.max())
    column, code_of = np.repeat(np.arange(k), codes), np.concatenate([np.arange(c) for c in codes])
    feature, code = [], []
    frozen, kept, lesser, above = np.zeros(1, bool), np.zeros(1), np.zeros(1, np.int64), None
    for level in range(s.depth):
        count = 1 << level
        sums = np.zeros((3, count, k, bins))
        asked = np.flatnonzero(~frozen[::2]) * 2 + lesser[~frozen[::2]] if level else np.zeros(1, np.int64)
        if len(asked):
            tree = Tree(np.concatenate(feature).astype(np.int32), np.concatenate(code).astype(shape.kind), np.zeros(count)) if level else None
            got = yield Ask(picked, tree, asked)
            own = np.zeros((3, len(asked), k, bins))
            own[:, :, column, code_of] = got
            sums[:, asked] = own
            if level:
                sums[:, asked ^ 1] = above[:, asked >> 1] - own
        gl, hl, cl = (v.cumsum(2) for v in sums)
        gl, hl = gl * unit, hl * unit
        gt, ht, ct = gl[:, :1, -1:], hl[:, :1, -1:], cl[:, :1, -1:]
        gr, hr, cr = gt - gl, ht - hl, ct - cl
        gain = gl * gl / (hl + s.ridge) + gr * gr / (hr + s.ridge) - gt * gt / (ht + s.ridge)
        gain = np.where((cl >= s.least) & (cr >= s.least), gain, -np.inf).reshape(count, -1)
        best, each = gain.argmax(1), np.arange(count)
        now = ~frozen & ~(gain[each, best] > 1e-9)
        kept = np.where(now, -gt[:, 0, 0] / (ht[:, 0, 0] + s.ridge), kept)
        frozen = frozen | now
        feature.append(np.where(frozen, 0, picked[best // bins]))
        code.append(np.where(frozen, shape.all_left, best % bins))
        lesser = (cl.reshape(count, -1)[each, best] > cr.reshape(count, -1)[each, best]).astype(np.int64)
        sides = [np.stack([v.reshape(count, -1)[each, best] for v in pair], axis=1).ravel() for pair in ((gl, gr), (hl, hr))]
        above, frozen, kept = sums, np.repeat(frozen, 2), np.repeat(kept, 2)
    value = s.rate * np.where(frozen, kept, -sides[0] / (sides[1] + s.ridge))
    feature, code = np.concatenate(feature).astype(np.int32), np.concatenate(code).astype(shape.kind)
    threshold = np.array([np.inf if c == shape.all_left else shape.threshold(f, c) for f, c in zip(feature.tolist(), code.tolist(), strict=True)], np.float32)
    return Tree(feature, threshold, value), Tree(feature, code, value)


@dataclass
class Group:
    """What the fit of a (fold, label) knows of its rows: the constant, what positives weigh more, and the unit of gradients."""

    start: float
    positive: float
    unit: float

    @classmethod
    def of(cls, n: int, most: float, whole: float, positive: float, s: Booster) -> "Group":
        share = min(max(positive / max(whole, 1e-12), 1e-6), 1 - 1e-6)
        more = (1 - share) / share if s.balanced else 1.0
        share = min(max(positive * more / max(whole - positive + positive * more, 1e-12), 1e-6), 1 - 1e-6)
        bits = 51 - int(np.ceil(np.log2(n * max(most * max(more, 1.0), 1.0) + 1)))
        return cls(float(np.log(share / (1 - share))), more, 2.0 ** -bits)

    def sides(self, block: Block, y: np.ndarray, margin: np.ndarray, s: Booster, stage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that a tree takes, and the gradients of all rows in units."""
        p = sigmoid(margin)
        w = np.where(y > 0, block.w * self.positive, block.w) if s.balanced else block.w
        known = ~np.isnan(y)
        if s.rows < 1:
            known &= block.drawn(s, stage)
        w = w / self.unit
        return np.flatnonzero(known), np.rint(w * (p - y)), np.rint(w * p * (1 - p))


# ---------------------------------------------------------------- records

_RECORDS = "fold int, start long, n int, codes binary, w binary, y binary"


def _blocks(batches: Iterator[pa.RecordBatch] | list[pa.RecordBatch], shapes: dict[int, Shape], labels: int,
            step: int = _STEP) -> Iterator[tuple[int, Block, np.ndarray, np.ndarray | None]]:
    """Fold, rows, labels and, where records have them, margins of records; some records of a fold at a time, or each on its own."""
    held: dict[int, list[tuple]] = {}

    def made(fold: int) -> tuple[int, Block, np.ndarray, np.ndarray | None]:
        starts, sizes, codes, w, y, *margins = zip(*held.pop(fold), strict=True)

        def joined(parts: tuple, kind: type = float) -> np.ndarray:
            return np.concatenate([np.frombuffer(p, kind).reshape(-1, n) for p, n in zip(parts, sizes, strict=True)], axis=1)
        weight = joined(w)[0]
        block = Block(shapes[fold], joined(codes, shapes[fold].kind), list(zip(starts, sizes, strict=True)), weight[:1] if (weight == weight[0]).all() else weight)
        return fold, block, joined(y).reshape(labels, -1), joined(margins[0]) if margins else None
    for batch in batches:
        names = [c for c in ("start", "n", "codes", "w", "y", "margin") if c in batch.schema.names]
        for fold, *record in zip(*(batch.column(c).to_pylist() for c in ("fold", *names)), strict=True):
            own = held.setdefault(fold, [])
            own.append(tuple(record))
            if sum(r[1] for r in own) + _RECORD > step:
                yield made(fold)
    for fold in list(held):
        yield made(fold)


class Coded:
    """The training rows of some folds as records, and the trees that have been grown on them."""

    def __init__(self, rows: DataFrame, sizes: dict[int, int], labels: list[str], s: Booster):
        """``rows``: ``fold, x, w`` and the labels (``y_<label>``)."""
        self.labels, self.sizes, self.spark = labels, sizes, rows.sparkSession
        self.shapes = {f: Shape(e) for f, e in exact_edges(rows, s.bins).items()}
        self.totals = self._totals(rows)
        self.records = self._records(rows)
        self.trees: dict[Key, list[Tree]] = {}
        #: Records with margins, and the trees that these have seen by group, in the order of the margins.
        self.state: DataFrame | None = None
        self.written: dict[Key, int] = {}

    def _totals(self, rows: DataFrame) -> dict[Key, tuple[int, float, float, float]]:
        """By fold and label: known rows, the largest weight, and the weights of all rows and of positives, in units whose sums are exact."""
        most = {r["fold"]: r["w"] for r in rows.groupBy("fold").agg(F.max(F.abs("w")).alias("w")).collect()}
        unit, kinds = F.lit(1.0), {f: 2.0 ** -(51 - int(np.ceil(np.log2(n * max(most[f] or 0.0, 1.0) + 1)))) for f, n in self.sizes.items()}
        for f, u in kinds.items():
            unit = F.when(F.col("fold") == f, u).otherwise(unit)
        whole, sums = F.rint(F.col("w") / unit), []
        for i, y in enumerate(self.labels):
            own = F.col(f"y_{y}")
            sums += [F.count(own).alias(f"n{i}"), F.sum(F.when(own.isNotNull(), whole)).alias(f"w{i}"), F.sum(whole * own).alias(f"p{i}")]
        return {(r["fold"], y): (r[f"n{i}"], most[r["fold"]] or 0.0, (r[f"w{i}"] or 0.0) * kinds[r["fold"]], (r[f"p{i}"] or 0.0) * kinds[r["fold"]])
                for r in rows.groupBy("fold").agg(*sums).collect() for i, y in enumerate(self.labels)}

    def _records(self, rows: DataFrame) -> DataFrame:
        shapes, labels = self.shapes, [f"y_{y}" for y in self.labels]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                folds = batch.column("fold").to_numpy()
                for fold in np.unique(folds).tolist():
                    some = batch.filter(pa.array(folds == fold))
                    for _, x in vectors_of([some]):
                        codes = np.ascontiguousarray(shapes[fold].coded(x))
                        flat = pa.py_buffer(codes.tobytes())
                        width = codes.shape[1] * codes.itemsize
                        made = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)[:len(x) + 1].tobytes()), flat])
                        yield pa.RecordBatch.from_arrays([some.column("fold"), made, *(some.column(c) for c in ("w", *labels))], names=["fold", "codes", "w", *labels])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seen, held = TaskContext.get().partitionId(), {}, []

            def record(fold: int, batch: pa.RecordBatch) -> pa.RecordBatch:
                size, first = batch.num_rows, seen.get(fold, 0)
                seen[fold] = first + size
                kind = shapes[fold].kind
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), kind).reshape(size, -1)
                y = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in labels])
                w = batch.column("w").to_numpy(zero_copy_only=False).astype(float)
                return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int32()),
                                                   *(pa.array([a.tobytes()], pa.binary()) for a in (np.ascontiguousarray(codes.T), w, y))],
                                                  names=["fold", "part", "start", "n", "codes", "w", "y"])

            def full(last: bool) -> Iterator[pa.RecordBatch]:
                # Rows come by fold: what is held of a fold goes out in records of one size, the rest when the fold ends.
                whole = pa.concat_batches(held)
                folds = whole.column("fold").to_numpy()
                held.clear()
                for fold in np.unique(folds).tolist():
                    at = np.flatnonzero(folds == fold)
                    lo, end = int(at[0]), int(at[-1]) + 1
                    going = not last and end == len(folds)
                    while lo < end and (end - lo >= _RECORD or not going):
                        yield record(fold, whole.slice(lo, min(_RECORD, end - lo)))
                        lo += _RECORD
                    if lo < end:
                        held.append(whole.slice(lo, end - lo))
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= _RECORD:
                    yield from full(False)
            if held:
                yield from full(True)
        kinds = ", ".join(f"`{c}` double" for c in labels)
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-sum(self.sizes.values()) // (_RECORD * _FILE)))
        coded = rows.select("fold", "x", "w", *labels).mapInArrow(code, f"fold int, codes binary, w double, {kinds}")
        order = ["fold", "place", "codes", "w", *labels]
        coded = coded.withColumn("place", F.xxhash64("codes", "w", *labels))
        coded = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        made = materialise(coded.drop("place").mapInArrow(pack, "fold int, part int, start long, n int, codes binary, w binary, y binary"), "packed")
        # Places in the whole order: those of earlier partitions come first.
        sizes = made.groupBy("fold", "part").agg(F.sum("n").alias("n")).collect()
        upto: dict[int, int] = {}
        firsts = []
        for r in sorted(sizes, key=lambda r: (r["fold"], r["part"])):
            firsts.append((r["fold"], r["part"], upto.get(r["fold"], 0)))
            upto[r["fold"]] = firsts[-1][2] + r["n"]
        first = F.broadcast(self.spark.createDataFrame(firsts, "fold int, part int, first long"))
        placed = made.join(first, ["fold", "part"]).select("fold", (F.col("start") + F.col("first")).alias("start"), "n", "codes", "w", "y")
        # Records are dealt out evenly.
        out = materialise(placed.repartition(parts), "records")
        discard(made)
        return out

    def grow(self, wanted: list[Key], settings: dict[int, Booster], rounds: int) -> dict[Key, list[Tree]]:
        """The next trees of the wanted groups over values; the first one ever is the constant."""
        wanted = [k for k in wanted if self.totals[k[0] % VARIANT, k[1]][0]]
        groups = {k: Group.of(*self.totals[k[0] % VARIANT, k[1]], settings[k[0] // VARIANT]) for k in wanted}
        left = {k: min(rounds, settings[k[0] // VARIANT].rounds - max(0, len(self.trees.get(k, [])) - 1)) for k in wanted}
        out: dict[Key, list[Tree]] = {k: [] for k in wanted}
        for k in wanted:
            if not self.trees.get(k):
                first = Tree(np.zeros(0, np.int32), np.zeros(0, np.float32), np.array([groups[k].start]))
                self.trees[k] = [first]
                out[k].append(first)
        small = [k for k in wanted if self.sizes[k[0] % VARIANT] * self.shapes[k[0] % VARIANT].row_bytes <= settings[k[0] // VARIANT].block_bytes]
        large = [k for k in wanted if k not in set(small)]
        for keys, run in ((small, self._in_tasks), (large, self._in_passes)):
            if keys:
                for k, (tree, code) in run(keys, groups, settings, left):
                    out[k].append(tree)
                    self.trees[k].append(code)
        return out

    def _in_tasks(self, keys: list[Key], groups: dict[Key, Group], settings: dict[int, Booster], left: dict[Key, int]) -> Iterator[tuple[Key, tuple[Tree, Tree]]]:
        """A task a group, the largest ones first."""
        keys = sorted(keys, key=lambda k: -self.sizes[k[0] % VARIANT])
        shapes, labels, done = self.shapes, self.labels, {k: self.trees[k] for k in keys}

        def grown(key: Key, blocks: list[tuple[Block, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            group, s, made = groups[key], settings[key[0] // VARIANT], []
            for stage in range(len(done[key]), len(done[key]) + left[key]):
                sides, tree = [group.sides(b, y, margin, s, stage) for b, y, margin in blocks], growing(shapes[key[0] % VARIANT], s, stage, group.unit)
                ask = next(tree)
                try:
                    while True:
                        ask = tree.send(sum(b.sums(ask, *own) for (b, _, _), own in zip(blocks, sides, strict=True)))
                except StopIteration as end:
                    made.append(end.value)
                for b, _, margin in blocks:
                    margin += made[-1][1].value.take(made[-1][1].leaves(b.columns))
            return pa.RecordBatch.from_arrays(
                [pa.array([keys.index(key)] * len(made), pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array([t.feature.tolist() for t, _ in made], pa.list_(pa.int32())),
                 pa.array([t.threshold.tolist() for t, _ in made], pa.list_(pa.float32())), pa.array([c.threshold.tolist() for _, c in made], pa.list_(pa.int32())),
                 pa.array([t.value.tolist() for t, _ in made], pa.list_(pa.float64()))], names=["id", "stage", "feature", "threshold", "code", "value"])

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Records come by group; a group grows as soon as its last one has come.
            runs = ((i, batch.slice(lo, 1)) for batch in batches for lo, i in enumerate(batch.column("id").to_pylist()))
            for i, own in groupby(runs, lambda run: run[0]):
                key = keys[i]
                blocks = [(block, y[labels.index(key[1])].copy(), block.margin(done[key])) for _, block, y, _ in _blocks((one for _, one in own), shapes, len(labels))]
                yield grown(key, blocks)
        asked = F.array().cast("array<int>")
        for fold in {k[0] % VARIANT for k in keys}:
            asked = F.when(F.col("fold") == fold, F.array(*[F.lit(i) for i, k in enumerate(keys) if k[0] % VARIANT == fold])).otherwise(asked)
        long = self.records.select(F.explode(asked).alias("id"), "*").repartitionByRange(len(keys), "id").sortWithinPartitions("id")
        found = long.mapInArrow(fit, "id int, stage int, feature array<int>, threshold array<float>, code array<int>, value array<double>")
        for r in sorted(found.collect(), key=lambda r: (r["id"], r["stage"])):
            key = keys[r["id"]]
            feature, value = np.array(r["feature"], np.int32), np.array(r["value"])
            yield key, (Tree(feature, np.array(r["threshold"], np.float32), value), Tree(feature, np.array(r["code"]).astype(self.shapes[key[0] % VARIANT].kind), value))

    def _in_passes(self, keys: list[Key], groups: dict[Key, Group], settings: dict[int, Booster], left: dict[Key, int]) -> Iterator[tuple[Key, tuple[Tree, Tree]]]:
        """A pass over the records per level, for all groups; they grow the same number of trees, or fewer."""
        first = {k: len(self.trees[k]) for k in keys}
        for i in range(max(left.values())):
            going = {k: growing(self.shapes[k[0] % VARIANT], settings[k[0] // VARIANT], first[k] + i, groups[k].unit) for k in keys if i < left[k]}
            self._write_margins(list(going))
            asks = {k: next(g) for k, g in going.items()}
            while asks:
                sums, more = self._pass(asks, groups, settings, {k: first[k] + i for k in asks}), {}
                for k, got in sums.items():
                    try:
                        more[k] = going[k].send(got)
                    except StopIteration as end:
                        yield k, end.value
                asks = more

    def _write_margins(self, keys: list[Key]) -> None:
        """Writes the margins of the groups anew where trees since the last writing are many, or where a group has none."""
        if self.state is not None and all(len(self.trees[k]) - self.written.get(k, -_PENDING) < _PENDING for k in keys):
            return
        folds = sorted({k[0] % VARIANT for k in keys})
        going = self.state is not None and {k[0] % VARIANT for k in self.written} >= set(folds)
        before, old = (self.state, list(self.written)) if going else (None, [])
        shapes, labels, trees = self.shapes, len(self.labels), {k: self.trees[k][self.written[k] if k in old else 0:] for k in keys}
        plain = ("fold", "start", "n", "codes", "w", "y")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    fold, block, _, known = next(_blocks([one], shapes, labels, 0))
                    place = {k: j for j, k in enumerate([k for k in old if k[0] % VARIANT == fold])}
                    own = [block.margin(trees[k], known[place[k]] if k in place else None) for k in keys if k[0] % VARIANT == fold]
                    yield pa.RecordBatch.from_arrays([*(one.column(c) for c in plain), pa.array([np.stack(own).tobytes()], pa.binary())], names=[*plain, "margin"])
        source = (self.records if before is None else before).where(F.col("fold").isin(folds))
        replaced, self.state = self.state, materialise(source.mapInArrow(write, f"{_RECORDS}, margin binary"), "margins")
        self.written = {k: len(self.trees[k]) for k in keys}
        if replaced is not None:
            discard(replaced)

    def _pass(self, asks: dict[Key, Ask], groups: dict[Key, Group], settings: dict[int, Booster], stages: dict[Key, int]) -> dict[Key, np.ndarray]:
        shapes, labels, slots = self.shapes, self.labels, list(self.written)
        ids, pending = list(asks), {k: self.trees[k][self.written[k]:] for k in asks}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for fold, block, y, margins in _blocks(batches, shapes, len(labels)):
                place = {k: j for j, k in enumerate([k for k in slots if k[0] % VARIANT == fold])}
                for i, k in enumerate(ids):
                    if k[0] % VARIANT != fold:
                        continue
                    margin = block.margin(pending[k], margins[place[k]])
                    rows, g, h = groups[k].sides(block, y[labels.index(k[1])], margin, settings[k[0] // VARIANT], stages[k])
                    more = block.sums(asks[k], rows, g, h)
                    total[i] = total[i] + more if i in total else more
            for i, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["id", "t"])

        def join(table: pa.Table) -> pa.Table:
            out = 0
            for t in table.column("t"):
                out = out + np.frombuffer(t.as_py())
            return pa.table({"id": table.column("id").slice(0, 1), "t": pa.array([out.tobytes()], pa.binary())})
        folds = sorted({k[0] % VARIANT for k in ids})
        source = self.state.where(F.col("fold").isin(folds))
        parts = source.mapInArrow(sums, "id int, t binary")
        if -(-sum(self.sizes[f] for f in folds) // (_RECORD * _FILE)) > _FAN:
            parts = parts.withColumn("salt", F.spark_partition_id() % _FAN).groupBy("id", "salt").applyInArrow(join, "id int, t binary")
        found = {r["id"]: np.frombuffer(r["t"]) for r in parts.groupBy("id").applyInArrow(join, "id int, t binary").collect()}
        return {k: found[i].reshape(3, len(asks[k].nodes), -1) for i, k in enumerate(ids)}
