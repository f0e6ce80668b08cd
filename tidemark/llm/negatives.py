"""Hard negatives by rotated one-bit codes: popcount estimates, exact intervals, integer scores for what survives.

Vectors are whole numbers (components times ``scale``, rounded down). Each is turned by one fixed rotation and keeps the
signs as its code, its norm, and how well its direction agrees with the code (``alignment``). An anchor's rotated vector is
rounded to ``PLANES`` bits per component, so that its product with any code is a sum of popcounts of bit planes.

With unit code c, direction u = a c + r and anchor q = q' + e, the score is norm * <u, q>, and

    |<u, q> - a <q', c>|  <=  sqrt(1 - a^2) * sqrt(|q'|^2 - <q', c>^2) + |e|

by Cauchy-Schwarz, as r is orthogonal to c. That interval always holds the score. Of a candidate set only those rows are scored whose
interval reaches the k-th best lower end, or, for negatives, the window and the third best lower end inside of it; the
others cannot be among the results, so these are exact.

Anchors (a stated part of the rows) meet all rows in cells of bounded size, a block of anchors by a block of rows; each cell
keeps its best per anchor, and these are merged by (score, id). Two rounds of cells: the anchors' positives, then the
negatives, for which a positive's score sets the window low * score <= 100 * negative <= high * score. No group depends
on labels or contents, so a hot label or vector makes no large task.

Defined cases: rows with a null id or label, and vectors that are null or hold a null or non-finite component, take no part;
components count as at most 2^31 - 1 in size, and a score beyond a long as the largest or smallest long; vectors of different
lengths are never compared; zero and empty vectors take part with score 0; rows equal in id, label and vector count once; a
row is no partner of its own id; ties go to the smaller id; a score below 0 leaves no window; an empty table gives an empty
table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tables import write

ROWS, ANCHORS, BATCH, PLANES = 4096, 4096, 64, 6
#: Rounding of the rotation and of sums, in parts of the product of both norms.
SLACK = 1e-9
_MOST = (1 << 31) - 1
_CODED = ["dim", "vec_id", "label", "v", "code", "alignment", "norm"]


@cache
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of ``size`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _turned(v: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, filled up to whole 64-bit words and rotated."""
    size = max(64, -(-v.shape[1] // 64) * 64)
    return v.astype(np.float64) @ rotation(size)[:, :v.shape[1]].T


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64-bit words), alignments and norms of the rows of ``v``."""
    turned = _turned(v)
    norm = np.sqrt((turned * turned).sum(1))
    code = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
    alignment = np.abs(turned).sum(1) / np.sqrt(turned.shape[1]) / np.where(norm > 0, norm, 1)
    return code, np.minimum(alignment, 1), norm


def intervals(q: np.ndarray, code: np.ndarray, alignment: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the scores of each anchor in ``q`` with each coded row."""
    turned = _turned(q)
    size = turned.shape[1]
    top = np.abs(turned).max(1, initial=0)
    step = np.where(top > 0, 2 * top / ((1 << PLANES) - 1), 1)
    level = np.rint((turned + top[:, None]) / step[:, None]).astype(np.int64)
    near = level * step[:, None] - top[:, None]
    error = np.sqrt(((turned - near) ** 2).sum(1))
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    inside = np.zeros((len(q), len(code)), np.int64)
    for j in range(PLANES):
        plane = np.packbits((level >> j & 1).astype(bool), axis=1, bitorder="little").view("<u8")
        for k in range(code.shape[1]):
            inside += np.bitwise_count(plane[:, k, None] & code[None, :, k]).astype(np.int64) << j
    product = (2 * (step[:, None] * inside - top[:, None] * ones) - near.sum(1)[:, None]) / np.sqrt(size)
    rest = np.sqrt(np.maximum((near * near).sum(1)[:, None] - product * product, 0))
    reach = np.sqrt(np.maximum(1 - alignment * alignment, 0)) * rest + error[:, None] + SLACK * np.sqrt((turned * turned).sum(1))[:, None]
    middle = alignment * product
    return norm * (middle - reach) - SLACK, norm * (middle + reach) + SLACK


def scores(q: np.ndarray, v: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer products of the pairs of anchors ``a`` and rows ``r``."""
    out = np.zeros(len(a), np.int64)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(1, v.shape[1])
    for lo in range(0, len(a), 1 << 15):
        x, y = q[a[lo:lo + (1 << 15)]], v[r[lo:lo + (1 << 15)]]
        if most < 1 << 63:
            out[lo:lo + len(x)] = np.einsum("nd,nd->n", x, y)
        else:
            ends = np.iinfo(np.int64)
            out[lo:lo + len(x)] = [min(max(sum(map(int.__mul__, s, t)), ends.min), ends.max) for s, t in zip(x.tolist(), y.tolist(), strict=True)]
    return out


def _best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` first of each ``who`` by falling score and rising id."""
    by = np.lexsort((ids, -score, who))
    who = who[by]
    return by[np.arange(len(by)) - np.searchsorted(who, who, side="left") < k]


def _kth(lower: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest lower end among the usable ones of each row, or minus infinity."""
    if lower.shape[1] < k:
        return np.full(len(lower), -np.inf)
    return -np.partition(-np.where(usable, lower, -np.inf), k - 1, axis=1)[:, k - 1]


def positives_of(q, q_ids, q_labels, rows, k: int):
    """``(anchor, row, score)`` of each anchor's ``k`` first rows of its label."""
    v, code, alignment, norm, ids, labels = rows
    lower, upper = intervals(q, code, alignment, norm)
    usable = (labels == q_labels[:, None]) & (ids != q_ids[:, None])
    a, r = np.nonzero(usable & (upper >= _kth(lower, usable, k)[:, None]))
    s = scores(q, v, a, r)
    keep = _best(a, s, ids[r], k)
    return a[keep], r[keep], s[keep]


def negatives_of(q, q_ids, q_labels, floor, ceiling, rows, k: int):
    """``(anchor, window, row, score)`` of the ``k`` first rows of other labels in each window of each anchor."""
    v, code, alignment, norm, ids, labels = rows
    lower, upper = intervals(q, code, alignment, norm)
    usable = (labels != q_labels[:, None]) & (ids != q_ids[:, None])
    alive = np.zeros(usable.shape, bool)
    for lo, hi in zip(floor.T, ceiling.T, strict=True):
        least = np.maximum(lo, _kth(lower, usable & (lower >= lo[:, None]) & (upper <= hi[:, None]), k))
        alive |= (upper >= least[:, None]) & (lower <= hi[:, None]) & (lo <= hi)[:, None]
    a, r = np.nonzero(usable & alive)
    s = scores(q, v, a, r)
    out = []
    for w, (lo, hi) in enumerate(zip(floor.T, ceiling.T, strict=True)):
        some = np.flatnonzero((s >= lo[a]) & (s <= hi[a]))
        some = some[_best(a[some], s[some], ids[r[some]], k)]
        out.append((a[some], np.full(len(some), w), r[some], s[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def coded(vectors: DataFrame, scale: int, key: str, label: str, vector: str) -> DataFrame:
    """The rows that take part, each once: ``dim, vec_id, label``, whole numbers ``v``, code, alignment and norm."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                          F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("v", lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(F.lit(float(scale)) * x))).cast("int"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(finite)
    rows = rows.select(F.size("v").alias("dim"), "vec_id", "label", whole.alias("v")).distinct()

    def run(batches):
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                v = some.column(3).flatten().to_numpy().reshape(len(some), dim)
                code, alignment, norm = encode(v)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()),
                     pa.array(alignment), pa.array(norm)], names=_CODED)
    return rows.mapInArrow(run, "dim int, vec_id long, label long, v binary, code binary, alignment double, norm double")


def _matrix(column: pa.ChunkedArray, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _loaded(table: pa.Table) -> tuple:
    n = table.num_rows
    return (_matrix(table.column("v"), "<i4", n).astype(np.int64), _matrix(table.column("code"), "<u8", n),
            *(table.column(c).to_numpy() for c in ("alignment", "norm", "vec_id", "label")))


class _Grid:
    """Cells of a block of anchors and a block of rows, each of bounded size."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, row_block: int, anchor_block: int):
        self.stripes = max(1, -(-rows.count() // row_block))
        self.blocks = max(1, -(-anchors.count() // anchor_block))
        block = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        self.rows = rows.select("*", F.pmod(F.xxhash64("vec_id", "label", F.lit(1)), F.lit(self.stripes)).cast("int").alias("stripe"), block.alias("block"))

    def run(self, anchors: DataFrame, look: Callable[[pa.Table, tuple], pa.Table], schema: str) -> DataFrame:
        stripe = F.explode(F.sequence(F.lit(0), F.lit(self.stripes - 1)))
        dealt = anchors.select("*", F.pmod(F.xxhash64("vec_id", "label", F.lit(2)), F.lit(self.blocks)).cast("int").alias("block"), stripe.alias("stripe"))

        def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
            held = _loaded(rows) if rows.num_rows else None
            parts = [look(asked.slice(lo, BATCH if held else 0), held) for lo in range(0, max(1, asked.num_rows), BATCH)]
            return pa.concat_tables(parts)
        by = ["dim", "stripe", "block"]
        return dealt.groupBy(*by).cogroup(self.rows.groupBy(*by)).applyInArrow(cell, schema)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "partner"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, key: str = "vec_id",
         label: str = "label", vector: str = "embedding", row_block: int = ROWS, anchor_block: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` tells anchors by the column ``vec_id``. Per anchor: its ``positives`` first rows of the same label; for each, the
    ``k`` first rows of other labels with low * positive <= 100 * negative <= high * positive.
    """
    if min(positives, k, row_block, anchor_block, scale) < 1:
        raise ValueError("positives, k, scale and the blocks must be positive")
    rows = write(coded(vectors, scale, key, label, vector), "coded")
    anchors = rows.where(is_anchor).select("dim", "vec_id", "label", "v", F.xxhash64("vec_id", "label", "v").alias("anchor"))
    grid = _Grid(rows, anchors, row_block, anchor_block)
    pairs = pa.schema([("anchor", pa.int64()), ("partner", pa.int64()), ("score", pa.int64())])

    def near(asked: pa.Table, held: tuple) -> pa.Table:
        if not asked.num_rows or held is None:
            return pairs.empty_table()
        q = _matrix(asked.column("v"), "<i4", asked.num_rows).astype(np.int64)
        a, r, s = positives_of(q, asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(), held, positives)
        return pa.table([asked.column("anchor").take(pa.array(a)), pa.array(held[4][r]), pa.array(s)], schema=pairs)
    best = _first(grid.run(anchors, near, "anchor long, partner long, score long"), ["anchor"], positives)
    best = best.select("anchor", F.col("place").alias("window"), F.col("partner").alias("positive_id"), F.col("score").alias("positive_score"))
    best = write(best, "positives")
    # At most ``positives`` small structs for each anchor, in the order of their place.
    windows = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("w"))
    asking = write(anchors.join(windows, "anchor").select("*", F.col("w.positive_score").alias("bars")).drop("w"), "windows")
    found = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("partner", pa.int64()), ("score", pa.int64())])

    def hard(asked: pa.Table, held: tuple) -> pa.Table:
        if not asked.num_rows or held is None:
            return found.empty_table()
        q = _matrix(asked.column("v"), "<i4", asked.num_rows).astype(np.int64)
        bars = asked.column("bars").to_pylist()
        ends = np.iinfo(np.int64)
        floor, ceiling = np.full((len(q), positives), ends.max), np.full((len(q), positives), ends.min)
        for i, row in enumerate(bars):
            floor[i, :len(row)] = [-(-low * s // 100) for s in row]
            ceiling[i, :len(row)] = [high * s // 100 for s in row]
        a, w, r, s = negatives_of(q, asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(), floor, ceiling, held, k)
        return pa.table([asked.column("anchor").take(pa.array(a)), pa.array(w + 1), pa.array(held[4][r]), pa.array(s)], schema=found)
    hits = _first(grid.run(asking, hard, "anchor long, window long, partner long, score long"), ["anchor", "window"], k)
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return (hits.join(best, ["anchor", "window"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("partner").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


#: All scores of all anchors.
ORACLE = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

