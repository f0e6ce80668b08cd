"""Periodic runs of words in a text, by Kruskal over descending common prefixes.

A run is a maximal stretch of words with smallest period q that is at least ``copies`` periods and ``least`` words
long. Runs of a document are found from its suffixes:

1. Suffixes are ranked by prefix doubling, which orders them and, with the ranks of every step, gives the longest
   common prefix of neighbours. Only documents in which some string of words stands twice that is as long as the
   prefix of the shortest run that could be found are ranked; a hash per place tells, and never misses one.
2. Neighbours are united by decreasing common prefix, with union-find over ordered sets of positions. When two
   classes meet at prefix length l, the smaller one is put into the larger. Two positions that are then next to each
   other, d apart with (copies - 1) * d <= l, are a seed: the text has period d from the first of them to l words
   behind the second, and no smaller one, as that would have put a position between them earlier.
3. The first words of a run and of its second period are such a pair, so the seeds that no word on the left extends
   are the runs, each once. Nothing is measured twice and no pair of positions is tried.

A document is one row of work; a word costs a logarithm, whatever repeats in it. Each partition is one pass without
a shuffle, so a hot source or a lost executor costs its own partitions only.

Defined cases: a null text has no words; runs never cross documents; very long texts are taken whole, in memory of some
hundred bytes a word; equal runs cannot occur, runs that start together are ordered by period, and the longest by
exponent is the first of equals; repeated rows are treated alike, each in a row of its own; a null id stays null; an empty
table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.tables import two

LEAST, COPIES = 24, 3
_PART = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start:long,length:long,period:long>>"
#: Ids and word counts of a block to the place of the word that stands at each place.
Rewrite = Callable[[list, np.ndarray], np.ndarray]


class Positions:
    """An ordered set of positions in short sorted parts, so that an insertion moves few of them."""

    __slots__ = ("parts", "tops", "size")

    def __init__(self, first: int):
        self.parts, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.parts) - 1)
        part = self.parts[k]
        insort(part, x)
        self.size += 1
        if len(part) > _PART:
            self.parts[k:k + 1] = part[:_PART // 2], part[_PART // 2:]
            self.tops[k:k + 1] = part[_PART // 2 - 1], part[-1]
        else:
            self.tops[k] = part[-1]

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members before and behind ``x``, which is one."""
        k = bisect_left(self.tops, x)
        part = self.parts[k]
        i = bisect_left(part, x)
        before = part[i - 1] if i else self.parts[k - 1][-1] if k else None
        behind = part[i + 1] if i + 1 < len(part) else self.parts[k + 1][0] if k + 1 < len(self.parts) else None
        return before, behind

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part


def _ranks(codes: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words of each suffix, up to the step that tells all apart.

    ``end`` is where the suffix's document ends; a document's codes are its own.
    """
    n, step = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1]
    levels = [rank.astype(np.int32)]
    while rank.max(initial=0) < n - 1:
        ahead = np.arange(n) + step
        inside = ahead < end
        key = rank * (n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
        step *= 2
    return levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``i`` and ``j``, in words."""
    n, length = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = i + length, j + length
        inside = (p < n) & (q < n)
        p, q = np.where(inside, p, 0), np.where(inside, q, 0)
        length += np.where(inside & (levels[k][p] == levels[k][q]), 1 << k, 0)
    return length


def shortest_prefix(least: int, copies: int) -> int:
    """The least common prefix that a seed of a run can have."""
    return min(max(least - d, (copies - 1) * d) for d in range(1, least + 1))


def seeds(u: list[int], v: list[int], lengths: list[int], n: int, least: int, copies: int) -> list[tuple[int, int, int]]:
    """``(position, distance, prefix)`` of newly adjacent positions within the prefix, uniting by the order given."""
    parent = list(range(n))
    held: dict[int, Positions] = {}
    out = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, length in zip(u, v, lengths, strict=True):
        a, b = find(a), find(b)
        left, right = held.pop(a, None), held.pop(b, None)
        if (left.size if left else 1) < (right.size if right else 1):
            a, b, left, right = b, a, right, left
        large = left or Positions(a)
        parent[b], held[a] = a, large
        small = list(right) if right else [b]
        for x in small:
            large.add(x)
        reach = length // (copies - 1)
        for x in small:
            before, behind = large.around(x)
            if before is not None and x - before <= reach and length + x - before >= least:
                out.append((before, x - before, length))
            if behind is not None and behind - x <= reach and length + behind - x >= least:
                out.append((x, behind - x, length))
    return out


def runs_of(codes: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, least: int = LEAST, copies: int = COPIES) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start and period, in places of the block.

    ``codes`` are equal for equal words of a document and never for those of two documents.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(codes):
        return none
    begin, end = first[doc], (first + count)[doc]
    levels = _ranks(codes, end)
    order = np.argsort(levels[-1])
    u, v = order[:-1], order[1:]
    prefix = _common(levels, u, v)
    keep = np.flatnonzero(prefix >= shortest_prefix(least, copies))
    keep = keep[np.argsort(-prefix[keep], kind="stable")]
    word = levels[0]
    found = seeds(u[keep].tolist(), v[keep].tolist(), prefix[keep].tolist(), len(codes), least, copies)
    if not found:
        return none
    at, d, length = np.array(found).T
    # Of a class that moves as a whole, pairs that were neighbours before come again with too short a prefix.
    stop = at + d + length
    whole = (stop == end[at]) | (word[np.minimum(stop, len(word) - 1)] != word[at + length])
    fresh = (at == begin[at]) | (word[at - 1] != word[at + d - 1])
    some = whole & fresh
    rows = np.stack([at[some], (d + length)[some], d[some]], axis=1)
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _suspects(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Documents in which some string of ``size`` words stands twice, by a hash of each."""
    h, done, base, total = hashes, 0, _MIX, None
    with np.errstate(over="ignore"):
        step = 1
        while step <= size:
            if size & step:
                part = h[done:]
                total = part if total is None else total[:len(part)] * base + part[:len(total)]
                done += step
            h, base = h[:max(0, len(h) - step)] * base + h[step:], base * base
            step *= 2
        place = np.arange(len(total))
        inside = place + size <= (first + count)[doc[place]]
        key = (total[inside] ^ (total[inside] >> np.uint64(31))) * _MIX + doc[place[inside]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    by = np.argsort(key)
    same = key[by[1:]] == key[by[:-1]]
    return np.unique(doc[place[inside][by[1:][same]]])


def planted(ids: list, count: np.ndarray) -> np.ndarray:
    """The stated rewriting of one document in ten: from some word on, its words repeat with a period that depends on the id."""
    first = np.cumsum(count) - count
    source = np.arange(int(count.sum()))
    for i, (doc_id, n) in enumerate(zip(ids, count.tolist(), strict=True)):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and n else 1
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[first[i] + a:first[i] + n] = first[i] + a + np.arange(n - a) % p
    return source


def collapse_block(texts: list[bytes], ids: list, least: int, copies: int, rewrite: Rewrite | None) -> tuple[list[list[dict]], list[str]]:
    """Runs of each text, and its words without those behind a run's first period."""
    w = K.Words(texts, K.SPACES, lower=False)
    source = rewrite(ids, w.count) if rewrite else np.arange(len(w.start))
    runs: list[list[dict]] = [[] for _ in texts]
    gone = np.zeros(len(source) + 1, np.int64)
    hashes = K.xxh64(w.data, w.start, w.end - w.start)[source]
    some = _suspects(hashes, w.doc, w.first, w.count, shortest_prefix(least, copies)) if len(hashes) else np.zeros(0, np.int64)
    view = memoryview(w.data)
    if len(some):
        count = w.count[some]
        place = K.ragged(w.first[some], count)
        known: dict[bytes, int] = {}
        begin, end = w.start[source[place]].tolist(), w.end[source[place]].tolist()
        word = np.fromiter((known.setdefault(bytes(view[a:b]), len(known)) for a, b in zip(begin, end, strict=True)), np.int64, len(place))
        doc = np.repeat(np.arange(len(some)), count)
        first = np.cumsum(count) - count
        found = runs_of(doc * len(known) + word, doc, first, count, least, copies)
        np.add.at(gone, place[found[:, 0]] + found[:, 2], 1)
        np.add.at(gone, place[found[:, 0]] + found[:, 1], -1)
        for (start, length, period), d in zip(found.tolist(), doc[found[:, 0]].tolist(), strict=True):
            runs[some[d]].append({"start": start - int(first[d]), "length": length, "period": period})
    kept = np.cumsum(gone[:-1]) == 0
    moved = np.add.reduceat(np.append((source != np.arange(len(source))) | ~kept, False), np.minimum(w.first, len(source))) if len(texts) else []
    out = []
    for first, count, change in zip(w.first.tolist(), w.count.tolist(), moved, strict=True):
        if not count:
            out.append("")
        elif not change:
            out.append(str(view[w.start[first]:w.end[first + count - 1]], "utf-8"))
        else:
            at = source[first:first + count][kept[first:first + count]]
            out.append(" ".join(str(view[a:b], "utf-8") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)))
    return runs, out


def collapse(docs: DataFrame, least: int = LEAST, copies: int = COPIES, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, runs, text`` of every row: its runs by start and period, and its words, one space apart, without those that
    only repeat a run's first period. ``rewrite`` stands in other words first."""
    if least < 1 or copies < 2:
        raise ValueError("least must be positive and copies at least 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for rows in batches:
            for a, b, texts in K.blocks(rows.column(1)):
                ids = rows.column(0).slice(a, b - a)
                runs, kept = collapse_block(texts, ids.to_pylist(), least, copies, rewrite)
                yield pa.RecordBatch.from_arrays([ids, pa.array(runs, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "text"])
    return two(docs).mapInArrow(run, f"doc_id long, runs {_RUNS}, text string")


def _best(runs: Column) -> Column:
    """The first of the runs with the greatest length per period, compared as whole numbers."""
    return F.reduce(runs, F.element_at(runs, 1), lambda best, x: F.when(
        x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def digest(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_runs``, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    found = collapse(docs, **settings)
    best = F.when(F.size("runs") > 0, _best(F.col("runs")))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                       F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                      milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
