"""Vectorised byte kernels over Arrow text columns; they run inside Spark tasks, batch by batch.

All kernels work on UTF-8 bytes. A batch is cut into row blocks of bounded bytes first, so that
memory follows the longest single document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 19
LONG_SPAN = 64

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: ASCII white space; and every ASCII byte that is no letter or digit.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[:128] = True
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161,
    9650029242287828579, 2870177450012600261))


def raw(texts) -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]


def blocks(texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of at most ``limit`` bytes and their texts; a longer text is a range of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lo, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > lo and size + n > limit:
            yield lo, i, raw(texts.slice(lo, i - lo))
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths), raw(texts.slice(lo))


class Words:
    """Words of a block of documents: ``data`` holds them lower-cased with one space after each.

    ``start``/``end`` are byte positions in ``data``, ``doc`` the row of each word, ``first`` the
    index of a row's first word and ``count`` its number of words.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool = True):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        inside = ~separators[joined]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        limits = np.cumsum(sizes)
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        begin, stop = edge[0::2], edge[1::2]
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        data = LOWER[joined] if lower else joined.copy()
        data[~inside] = 32
        self.data = np.concatenate([data[kept], np.zeros(16, np.uint8)])
        length = stop - begin
        self.start = np.zeros(len(begin), np.int64)
        np.cumsum(length[:-1] + 1, out=self.start[1:])
        self.end = self.start + length
        self.doc = np.searchsorted(limits, begin, side="right")
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans at once, long ones by the library. ``data`` needs 8 bytes of padding at its end."""
    data = np.ascontiguousarray(data)
    u64 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    u32 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    begin, size = start.astype(np.int64), length.astype(np.int64)
    far = size >= LONG_SPAN
    start, length = np.where(far, 0, begin), np.where(far, 0, size)
    s = np.uint64(seed)
    h = np.full(len(start), s + _P5, dtype=np.uint64)
    at = start.copy()
    with np.errstate(over="ignore"):
        long = np.flatnonzero((length >= 32) & (length < LONG_SPAN))
        if len(long):
            acc = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes, pos, live, turn = length[long] // 32, at[long].copy(), np.arange(len(long)), 0
            while len(live):
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], u64[pos[live] + 8 * k])
                pos[live] += 32
                turn += 1
                live = live[stripes[live] > turn]
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.uint64(0), a)) * _P1 + _P4
            h[long], at[long] = x, pos
        h += length.astype(np.uint64)
        left = start + length - at
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _round(np.uint64(0), u64[at[i]]), 27) * _P1 + _P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rotl(h[i] ^ (u32[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left >= 1)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (data[at[i]].astype(np.uint64) * _P5), 11) * _P1
            at[i] += 1
            left[i] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    view = memoryview(data)
    for i in np.flatnonzero(far).tolist():
        h[i] = xxhash.xxh64_intdigest(view[begin[i]:begin[i] + size[i]], seed)
    return h


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, counts)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` values (0 for empty groups)."""
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array,)) else pa.array(c, type=f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)
