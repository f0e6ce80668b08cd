"""Removal of long repeated byte strings by run-length indexes over content-routed segments.

A byte goes when a ``span``-byte string that covers it also starts somewhere else in the corpus.

1. Routing. Each window of ``span`` bytes is named by the smallest hash of the ``gram``-byte strings in it. Equal
   windows have equal names wherever they stand, so only windows of one name need comparing. Consecutive window
   starts of one name form a segment. Names whose string stands once in the corpus are done; equal segments collapse to one
   with a count, and a count of two or more marks all its windows. This keeps copies out of what follows.
2. Indexing. Names that have several different segments are dealt to shards of bounded bytes. A shard sorts the
   suffixes of its segments, run-compresses the Burrows-Wheeler transform and keeps the suffix at each run's ends.
   The match length with the neighbour in suffix order is measured at run ends only; inside a run it falls by one
   with each text position, so streaming over the text yields all match lengths (towards either neighbour), and a
   window is marked where one reaches ``span``.
3. A name whose different segments exceed ``shard_bytes`` on their own would be one task that grows. Its windows
   are counted by a 128-bit hash instead: one row per byte, summed before the shuffle; exact at any size.
4. Marks go back to every place of a segment, and each text is cut once.

Defined cases: a null text is empty; texts shorter than ``span`` bytes stay; a text is compared with itself too;
repeated rows are copies of each other, whatever their id; an empty table gives an empty table; other columns are
ignored. What is kept is bytes, as a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.sketch import sketch
from tidemark.llm.tables import two, write

SPAN, GRAM, SHARD_BYTES = 200, 32, 1 << 19
_TABLES = np.random.default_rng(8).integers(0, 1 << 64, (3, 256), dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = ["doc_key", "text_key", "start", "count"]


def _keyed(docs: DataFrame) -> DataFrame:
    rows = two(docs).where("text is not null")
    return rows.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), F.xxhash64("text").alias("text_key"), "text")


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of the ``gram`` bytes from each position; strings of powers of two are put together."""
    with np.errstate(over="ignore"):
        h, size, base, done, total = _TABLES[0][data], 1, _BASE, 0, None
        while size <= gram:
            if gram & size:
                part = h[done:]
                total = part if total is None else total[:len(part)] * _power(size) + part[:len(total)]
                done += size
            h = h[:max(0, len(h) - size)] * base + h[size:]
            base = base * base
            size *= 2
        g = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def lowest(g: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the ``width`` values from each position."""
    low, size = g, 1
    while size * 2 <= width:
        low = np.minimum(low[:len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[:len(g) - width + 1], low[width - size:])


def occurrences(g: np.ndarray, name: np.ndarray, begin: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """How often the gram that names a segment stands in it: more than once if windows repeat inside.

    A gram is smallest in a window only if it is so over half a window to one side; few others need a look.
    """
    half = (width - 1) // 2 + 1
    around = lowest(g, half)
    likely = np.ones(len(g), bool)
    right = np.ones(len(g), bool)
    right[:len(around)] = g[:len(around)] == around
    likely[half - 1:] = g[half - 1:] == around
    at = np.flatnonzero(likely | right)
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, stop + width - 1)
    n = hi - lo
    same = g[at[K.ragged(lo, n)]] == np.repeat(name[begin], n)
    return K.segment_sums(same, n).astype(np.int64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """``name, body, hits, doc_key, text_key, start, count``: runs of window starts of one name.

    ``body`` is a hash of the bytes they see, ``hits`` how often the naming gram stands there.
    """
    columns, width = ["name", "body", "hits", *_PLACE], span - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, _, texts in K.blocks(rows.column(2)):
                some = [i for i, t in enumerate(texts) if len(t) >= span]
                if not some:
                    continue
                size = np.array([len(texts[i]) for i in some])
                data = np.frombuffer(b"".join(texts[i] for i in some) + bytes(8), np.uint8)
                g = grams(data[:-8], gram)
                name = lowest(g, width)
                doc = np.repeat(np.arange(len(some)), size)[:len(name)]
                first = np.cumsum(size) - size
                valid = np.arange(len(name)) <= (first + size - span)[doc]
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
                begin = np.flatnonzero(new & valid)
                stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
                body = K.xxh64(data, begin, stop - begin + span - 1)
                at = pa.array(np.array(some)[doc[begin]] + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[begin].view(np.int64)), pa.array(body.view(np.int64)),
                     pa.array(occurrences(g, name, begin, stop, width)), rows.column(0).take(at), rows.column(1).take(at),
                     pa.array(begin - first[doc[begin]]), pa.array(stop - begin)], names=columns)
    return _keyed(docs).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _firsts(codes[order])
    step = 1
    tied = _tied(rank[order])
    while tied.any():
        at = order[tied]
        ahead = at + step
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        sorted_key = key[by]
        slots = np.flatnonzero(tied)
        rank[at[by]] = slots[_firsts(sorted_key)]
        step *= 2
        still = np.zeros(n, bool)
        still[slots[_tied(sorted_key)]] = True
        tied = still
    return order


def _firsts(values: np.ndarray) -> np.ndarray:
    """For sorted values, the index of the first equal one."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _tied(values: np.ndarray) -> np.ndarray:
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[1:] == values[:-1]
    return same[1:] | same[:-1]


def match_lengths(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each position of the joined bodies with any other place in them; and where bodies start.

    Matches end with their bodies. One position stands between bodies.
    """
    size = np.array([len(b) for b in bodies])
    first = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\0".join(bodies) + b"\0" + bytes(8), np.uint8)
    n = int(size.sum()) + len(bodies)
    ends = first + size
    codes = data[:n].astype(np.int64) + len(bodies)
    codes[ends] = np.arange(len(bodies))  # no two ends are equal, so that no match runs over one
    order = suffix_order(codes)
    before = codes[order - 1]  # the transform; position 0 is preceded by the last end
    edge = before[1:] != before[:-1]
    room = np.repeat(ends, size + 1) - np.arange(n)
    best = np.zeros(n, np.int64)
    for at, other, cut in ((order[1:], order[:-1], edge), (order[:-1], order[1:], edge)):
        # Sampled run ends: here the match with the neighbour is measured.
        p, q = at[cut], other[cut]
        length = _common(data, p, q, np.minimum(room[p], room[q]))
        by = np.argsort(p)
        p, length = p[by], length[by]
        near = np.searchsorted(p, np.arange(n), side="right") - 1
        stream = np.where(near >= 0, length[near] - (np.arange(n) - p[near]), 0) if len(p) else np.zeros(n, np.int64)
        best = np.maximum(best, stream)
    return best, first


def _common(data: np.ndarray, p: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at ``p`` and ``q``, at most ``limit``."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = np.zeros(len(p), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        at = length[live]
        diff = wide[p[live] + at] ^ wide[q[live] + at]
        same = np.full(len(live), 8)
        some = np.flatnonzero(diff)
        low = diff[some] & (~diff[some] + np.uint64(1))
        same[some] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        length[live] = at + same
        live = live[(same == 8) & (length[live] < limit[live])]
    return np.minimum(length, limit)


def _runs(flags: np.ndarray) -> np.ndarray:
    """Starts and stops of the runs of true flags, alternating."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))


def _index_shard(span: int):
    def index(group: pa.Table) -> pa.Table:
        bodies = group.column("bytes").to_pylist()
        best, first = match_lengths(bodies)
        runs = [_runs(best[f:f + len(b) - span + 1] >= span).tolist() for f, b in zip(first, bodies, strict=True)]
        return pa.table({"name": group.column("name"), "body": group.column("body"), "runs": pa.array(runs, pa.list_(pa.int64()))})
    return index


def _bodies(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """``name, body, bytes`` of the wanted segments, cut from their texts: each has one carrier, and a filter of fixed size keeps
    most other texts from being sent on."""
    per = write(wanted.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("name", "body", "start", "count")).alias("parts")), "wanted")
    likely = sketch(per, "text_key")

    def carriers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = likely.holds(batch.column(1).to_numpy())
            if held.any():
                yield batch.filter(pa.array(held))
    rows = _keyed(docs).mapInArrow(carriers, "doc_key long, text_key long, text string")
    # Rows that share id and text are one carrier; copies under other ids are no wanted ones.
    rows = rows.join(per.select("doc_key", "text_key").hint("merge"), ["doc_key", "text_key"], "left_semi")
    rows = rows.groupBy("doc_key", "text_key").agg(F.first("text").alias("text"))
    rows = rows.join(per.hint("merge"), ["doc_key", "text_key"]).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, parts in zip(K.raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["name"] for p in parts], pa.int64()), pa.array([p["body"] for p in parts], pa.int64()),
                     pa.array([text[p["start"]:p["start"] + p["count"] + span - 1] for p in parts], pa.binary())],
                    names=["name", "body", "bytes"])
    return rows.mapInArrow(run, "name long, body long, bytes binary")


def _by_windows(bodies: DataFrame, span: int) -> DataFrame:
    """Runs of repeated windows of crowded names, by counting all their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(text, np.uint8)
                hashes = []
                with np.errstate(over="ignore"):
                    powers, back = (_powers(base, len(x)) for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))
                    shift = back[:len(x) - span + 1]
                    for values in _TABLES[1:]:
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[x] * powers, dtype=np.uint64)])
                        hashes.append(((total[span:] - total[:-span]) * shift).view(np.int64))
                k = len(hashes[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name)), pa.array(np.full(k, body)), pa.array(np.arange(k)),
                                                  *map(pa.array, hashes)], names=["name", "body", "at", "p", "q"])
    rows = bodies.mapInArrow(run, "name long, body long, at long, p long, q long")
    # Written, so that the join shuffles both sides anew and can split a window with very many places.
    again = write(rows.groupBy("p", "q").count().where("count > 1").select("p", "q"), "windows")
    found = rows.join(again.hint("merge"), ["p", "q"]).groupBy("name", "body").agg(F.array_sort(F.collect_set("at")).alias("at"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for at in batch.column(2).to_pylist():
                flags = np.zeros(at[-1] + 1, bool)
                flags[at] = True
                runs.append(_runs(flags).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))],
                                             names=["name", "body", "runs"])
    return found.mapInArrow(join, "name long, body long, runs array<long>")


def repeated(docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_key, text_key, runs``: runs of window starts of each text that stand elsewhere too."""
    if not 1 <= gram <= span:
        raise ValueError("gram must be between 1 and span")
    found = segments(docs, span, gram)
    met = write(found.groupBy("name").agg(F.sum("hits").alias("n")).where("n > 1").select("name"), "names")
    shared = write(found.join(met.hint("merge"), "name"), "shared")
    bodies = write(shared.groupBy("name", "body").agg(F.count("*").alias("n"), F.max("hits").alias("hits"), F.min(F.struct(*_PLACE)).alias("place")), "bodies")
    # Each segment counts its separator too. Names of one segment whose gram stands there once need no index.
    sizes = (bodies.groupBy("name").agg(F.count("*").alias("m"), F.max("hits").alias("most"), F.sum(F.col("place.count") + span).alias("size"))
             .where("m > 1 or most > 1"))
    several = write(bodies.join(sizes.hint("merge"), "name").select("name", "body", "n", "size", "place.*"), "several")
    small = several.where(F.col("size") <= shard_bytes)
    total = small.agg(F.sum(F.col("count") + span)).first()[0] or 0
    shards = max(1, -(-total // max(1, shard_bytes)))
    texts = write(_bodies(docs, several, span), "texts") if not several.isEmpty() else None
    whole = bodies.where("n > 1").select("name", "body", F.array(F.lit(0).cast("long"), F.col("place.count")).alias("runs"))
    marks = whole
    if texts is not None:
        names_small = small.select("name").distinct().hint("merge")
        part = texts.join(names_small, "name").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
        indexed = part.groupBy("shard").applyInArrow(_index_shard(span), "name long, body long, runs array<long>")
        crowded = several.where(F.col("size") > shard_bytes).select("name").distinct()
        counted = _by_windows(texts.join(crowded, "name"), span)
        single = bodies.where("n = 1").select("name", "body").hint("merge")
        marks = whole.union(indexed.union(counted).join(single, ["name", "body"]).where(F.size("runs") > 0))
    marks = write(marks, "marks")
    placed = shared.join(marks.hint("merge"), ["name", "body"])
    moved = F.transform("runs", lambda x: x + F.col("start"))
    return write(placed.select("doc_key", "text_key", moved.alias("runs")).groupBy("doc_key", "text_key")
                 .agg(F.flatten(F.collect_set("runs")).alias("runs")), "runs")


def cut(text: bytes, runs: list[int], span: int) -> tuple[bytes, int, int]:
    """The kept bytes, how many went, and in how many maximal runs; ``runs`` alternate starts and stops of windows."""
    pairs = sorted(zip(runs[::2], runs[1::2], strict=True))
    kept, at, gone, spans, last = [], 0, 0, 0, -1
    for lo, hi in pairs:
        hi += span - 1
        if lo > last:
            spans += 1
            kept.append(text[at:lo])
        begin = max(lo, at)
        if hi > begin:
            gone += hi - begin
        at = last = max(at, hi)
    kept.append(text[at:])
    return b"".join(kept), gone, spans


def remove(docs: DataFrame, span: int = SPAN, with_bytes: bool = False, **settings) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row and, if asked, the ``kept`` bytes."""
    runs = repeated(docs, span, **settings)
    rows = two(docs).withColumn("doc_key", F.coalesce("doc_id", F.lit(-1))).withColumn("text_key", F.xxhash64("text"))
    rows = rows.join(runs.hint("merge"), ["doc_key", "text_key"], "left").select("doc_id", "text", "runs")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in K.blocks(batch.column(1)):
                some = batch.slice(a, b - a)
                out = [cut(t, r or [], span) for t, r in zip(texts, some.column(2).to_pylist(), strict=True)]
                parts = [some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                         pa.array([o[2] for o in out], pa.int64()), pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string())]
                yield pa.RecordBatch.from_arrays([*parts, *([pa.array([o[0] for o in out], pa.binary())] if with_bytes else [])], names=columns)
    kinds = {"kept_sha256": "string", "kept": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns))
