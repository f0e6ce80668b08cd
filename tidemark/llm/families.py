"""Candidate pairs within two edits among very many lines that share most of their text, without pairing a crowd.

A longer line A becomes a line B of ``size`` units by two edits of one of four kinds: two substitutions, a deletion and a
substitution in either order, or two deletions. (A deletion with an insertion leaves a common line with one unit less, which is
an equality on its own.) Each edit falls into one of a few ranges of B, so A and B are equal outside of two ranges, with A's text
shifted by the deletions before it. Every line names what is outside of each two ranges, as B and as A, by a hash of (kind, ranges,
text); lines of one name and kind are candidates.

* A name that few lines share gives its pairs, of lines whose units differ in number as little as two edits allow (``sign``): the others
  are not sent on to be compared.
* A name that many share is cut anew: each of its two ranges into parts, which give finer names, and only those lines
  name them. Ranges end as single units (substitutions) or as gaps between units (deletions). Then all lines of a name
  are two edits or fewer from any of them that has the part of B, so they are linked to one of these, without pairs.

Rows for a line are a constant per round and crowded name, rounds a logarithm of its length. Lines that are known to be connected
are never paired: a name counts only while it holds two classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import drop, write

#: Parts that a range is cut into; one of at most ``FULL`` units is cut into these at once.
PARTS, FULL = 6, 16
#: By kind: whether the first and the second edit is a deletion.
_DELETES = ((0, 0), (1, 0), (0, 1), (1, 1))
_TABLES = np.random.default_rng(9).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = (0x9FB21C651E98DF25 | 1, 0xA24BAED4963EE407 | 1)
_MASK = ["kind", "own", "size", "a1", "b1", "a2", "b2"]
_SCHEMA = ("h1 long, h2 long, root long, sign long, kind byte, own boolean, size int, a1 int, b1 int, a2 int, b2 int, p long, q long, done boolean")


class Prefixes:
    """Two hashes of any stretches of a line, put together with shifts."""

    def __init__(self, line: bytes | str):
        wide = isinstance(line, str)
        x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") if wide else np.frombuffer(line, np.uint8)
        self.sums = []
        with np.errstate(over="ignore"):
            for values, base in zip(_TABLES, _BASES, strict=True):
                known = values[x & 255] + (x >> 8).astype(np.uint64) * values[x >> 8 & 255] if wide else values[x]
                powers = np.full(len(x) + 1, base, np.uint64)
                powers[0] = 1
                terms = known * np.cumprod(powers, dtype=np.uint64)[:-1]
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def outside(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what is outside of both ranges of each row of masks, and of the masks themselves."""
        kind, own, size, a1, b1, a2, b2 = rows.T
        deletes = np.array(_DELETES)[kind] * (1 - own)[:, None]
        first, both = deletes[:, 0], deletes.sum(1)
        middle = np.maximum(b1, a2)
        out = []
        with np.errstate(over="ignore"):
            names = kind.astype(np.uint64)
            for part in (size, a1, b1, a2, b2):
                names = names * np.uint64(0xD6E8FEB86659FD93) + part.astype(np.uint64)
            for sums, base in zip(self.sums, _BASES, strict=True):
                back = np.array([pow(base, -k, 1 << 64) for k in range(3)], np.uint64)
                total = (sums[a1] + (sums[middle + first] - sums[b1 + first]) * back[first] + (sums[size + both] - sums[b2 + both]) * back[both])
                total = (total ^ (total >> np.uint64(32))) * np.uint64(base) + names * np.uint64(0x9E3779B97F4A7C15)
                out.append(total.view(np.int64))
        return out[0], out[1]


def sign(line: bytes | str) -> int:
    """For each of 64 classes of units, whether their number is odd. One edit changes two of these bits at most."""
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") if isinstance(line, str) else np.frombuffer(line, np.uint8)
    with np.errstate(over="ignore"):
        places = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return int(np.bitwise_xor.reduce(np.uint64(1) << places).view(np.int64)) if len(x) else 0


def first_masks(n: int, least: int) -> np.ndarray:
    """Masks of a whole line of ``n`` units: as the shorter line of each kind, and as the longer one."""
    rows = []
    for kind, (one, two) in enumerate(_DELETES):
        for own, size in ((1, n), (0, n - one - two)):
            if (kind == 0 and not own) or size < least:
                continue
            edges = [size * k // PARTS for k in range(PARTS + 1)]
            parts = list(zip(edges, edges[1:], strict=False))
            rows += [(kind, own, size, *u, *v) for i, u in enumerate(parts) for v in parts[i:]]
    return np.array(rows, np.int64).reshape(-1, 7)


def _parts(lo: int, hi: int, deletes: int, size: int) -> list[tuple[int, int]]:
    """A range cut for one kind of edit: down to a unit, or to the gap before one (and the last one)."""
    width = hi - lo
    if width <= FULL:
        if deletes:
            return [(g, g) for g in range(lo, hi + (hi == size))] if width else [(lo, lo)]
        return [(u, u + 1) for u in range(lo, hi)] or [(lo, hi)]
    count = min(PARTS, width)
    edges = [lo + width * k // count for k in range(count + 1)]
    return list(zip(edges, edges[1:], strict=False))


def finer(mask: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The masks that cover the ways in which a mask's two edits can lie in its ranges."""
    kind, own, size, a1, b1, a2, b2 = mask
    one, two = _DELETES[kind]
    same = (a1, b1) == (a2, b2)
    return [(kind, own, size, *u, *v) for u in _parts(a1, b1, one, size) for v in _parts(a2, b2, two, size)
            if u[1] <= v[0] or (u == v and same)]


def is_done(rows: np.ndarray) -> np.ndarray:
    """Whether no range can be cut further."""
    deletes = np.array(_DELETES)[rows[:, 0]]
    width = rows[:, [4, 6]] - rows[:, [3, 5]]
    return ((width == 0) | ((deletes == 0) & (width <= 1))).all(1)


def _rows(members: DataFrame, units: Callable[[bytes], bytes | str], least: int) -> DataFrame:
    """Names of the lines ``id, body, root``, from scratch or by their ``masks``."""
    given = "masks" in members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, body in enumerate(columns[3]):
                line = units(body)
                if given:
                    masks = np.array(sorted({f for m in columns[4][i] for f in finer(tuple(int(m[c]) for c in _MASK))}), np.int64).reshape(-1, 7)
                else:
                    masks = first_masks(len(line), least)
                if not len(masks):
                    continue
                p, q = Prefixes(line).outside(masks)
                k = len(masks)
                ids = [pa.array(np.full(k, columns[j][i])) for j in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(np.full(k, sign(line))), pa.array(masks[:, 0].astype(np.int8)), pa.array(masks[:, 1].astype(bool)), *(pa.array(masks[:, j].astype(np.int32)) for j in range(2, 7)),
                     pa.array(p), pa.array(q), pa.array(is_done(masks))], names=["h1", "h2", "root", "sign", *_MASK, "p", "q", "done"])
    return members.select("id.h1", "id.h2", "root", "body", *(["masks"] if given else [])).mapInArrow(run, _SCHEMA)


def pairs(lines: DataFrame, units: Callable[[bytes], bytes | str], least: int, bucket: int) -> DataFrame | None:
    """Candidate pairs ``a, b`` with the components of all pairs of ``lines`` (``id, body, root``) within two edits that lie in
    different classes ``root``, apart from those that one unit left out of both makes equal."""
    found, members = [], lines
    while True:
        rows = write(_rows(members, units, least).withColumn("id", F.struct("h1", "h2")), "masks")
        centre = F.min(F.when(F.col("own"), F.struct("id", "root"))).alias("centre")
        groups = rows.groupBy("p", "q").agg(F.count("*").alias("n"), F.count_if("own").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), centre,
                                            F.max("kind").alias("k"))
        groups = write(groups.where("n > 1 and m > 0 and low < high and (k = 0 or m < n)").select("p", "q", "n", "centre"), "mask-groups")
        met = write(rows.join(groups.hint("merge"), ["p", "q"]), "masked")
        star = met.where(F.col("done") & (F.col("root") != F.col("centre.root"))).select(F.col("id").alias("a"), F.col("centre.id").alias("b"))
        few = met.where((~F.col("done")) & (F.col("n") <= bucket))
        left = few.where("own").select("p", "q", F.col("id").alias("a"), F.col("root").alias("r"), F.col("sign").alias("s"))
        right = few.select("p", "q", F.col("id").alias("b"), "root", "own", "kind", "sign")
        cold = left.join(right, ["p", "q"]).where("r <> root and (not own or (kind = 0 and a < b)) and bit_count(s ^ sign) <= 4").select("a", "b")
        found.append(write(star.union(cold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "mask-pairs"))
        crowded = met.where((~F.col("done")) & (F.col("n") > bucket))
        masks = crowded.groupBy("id").agg(F.collect_set(F.struct(*_MASK)).alias("masks"))
        masks = write(masks, "crowded-masks")
        for done in (rows, groups, met):
            drop(done)
        if masks.isEmpty():
            break
        members = lines.join(masks.hint("merge"), "id")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()
