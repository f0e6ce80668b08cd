"""Line deduplication: a segment-partition edit join over all lines.

Lines (between newlines) of at least ``min_bytes`` are compared; the others stay, or with ``exact`` are
compared for equality from that many bytes on. Two lines link when at most ``max_edits`` insertions,
deletions or substitutions of bytes, or with ``characters`` of code points, lead from one to the other; classes are the components of links, and a class keeps its first line by (doc_id, line).

* A line is cut into ``max_edits + 1`` even segments. If it is within the threshold of a line that is
  not shorter, one segment occurs there unchanged, shifted by little; which shifts need a look for
  each length difference follows from the edits that can lie left and right of the segment. So a
  line names its own segments and those substrings, as hashes of (segment, length, bytes).
* Equal lines collapse to one (128-bit hash) before anything is joined. Names shared by several lines
  are counted, their members met by an equality join, and candidates verified on the bytes by a
  banded bit-parallel edit distance.
* A name shared by more than ``bucket`` lines would emit the square of them. Its members go another
  exact way: lines that are equal once byte ``i`` is left out differ only there, and a line that becomes
  another by leaving out a byte is one edit from it. Both are equality keys whose groups are linked to
  one member: one row per byte, no pairs. For two edits, lines that leave one string when a byte is left out of each are
  linked in this way too, and what is still unconnected is met by names of all but two ranges, cut ever finer where they are
  crowded (``families.py``). For three and more edits the lines outside of a name's largest class are paired
  with those of other classes, which is exact but can be quadratic; no registered query does so.

Texts are read twice more (candidate lines, the final cut) rather than carried through shuffles; a filter of fixed size
keeps all but candidate lines from being sent on.

Defined cases: a null text has no lines and stays null; a null id comes last in the order; rows that share
an id are equal in it, so repeated rows keep the same lines; a document may lose all its lines
and then has an empty text; an empty table gives an empty table; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import families
from tidemark.llm import kernels as K
from tidemark.llm.components import components
from tidemark.llm.sketch import sketch
from tidemark.llm.tables import two, write

MIN_BYTES = 32
#: Least length of lines that the query links by edits; shorter ones are compared for equality.
MIN_CHARACTERS = 16


class Rule(NamedTuple):
    """What is compared: edits of bytes or of characters, between lines of at least ``least`` of them. Lines of at least
    ``exact`` bytes are compared for equality; without it, only those of ``least``."""

    edits: int = 1
    least: int = MIN_BYTES
    characters: bool = False
    exact: int | None = None


class Lines:
    """Positions of the comparable lines of a block of texts, in bytes; ``length`` is in the unit of the edits."""

    def __init__(self, texts: list[bytes], rule: Rule):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), np.uint8)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        end = np.flatnonzero(self.data[:int(size.sum())] == 10)
        start = np.concatenate([np.zeros(1, np.int64), end[:-1] + 1])
        doc = np.searchsorted(np.cumsum(size) - 1, end, side="left")
        number = np.arange(len(end)) - np.searchsorted(doc, doc, side="left")
        head = np.flatnonzero((self.data & 0xC0) != 0x80) if rule.characters else None
        first, last = (start, end) if head is None else (np.searchsorted(head, start), np.searchsorted(head, end))
        long = (end - start >= rule.exact) if rule.exact is not None else last - first >= rule.least
        self.head, self.first, self.length = head, first[long], (last - first)[long]
        self.fuzzy = self.length >= rule.least
        self.start, self.end, self.doc, self.number = start[long], end[long], doc[long], number[long]
        self.size = self.end - self.start
        self.text = np.cumsum(size) - size, size - 1

    def at(self, place: np.ndarray) -> np.ndarray:
        """The byte at which the unit numbered ``place`` of the block begins."""
        return place if self.head is None else self.head[place]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return (K.xxh64(self.data, self.start, self.size, 42).view(np.int64),
                K.xxh64(self.data, self.start, self.size, 7).view(np.int64))


def names(max_edits: int) -> list[tuple[int, int, int]]:
    """``(length difference, segment, shift)`` of the substrings that a line names; its own segments come first.

    A segment may start ``shift`` bytes later in the longer line: at most ``segment`` edits can lie before it if all
    segments before it are hit, at most the others' number behind it.
    """
    own = [(0, i, 0) for i in range(max_edits + 1)]
    probes = [(d, i, s) for d in range(max_edits + 1) for i in range(max_edits + 1)
              for s in range(max(-i, d - (max_edits - i)), min(i, d + (max_edits - i)) + 1)]
    return own + [p for p in probes if p not in own]


def _name(lines: Lines, max_edits: int, diff: int, segment: int, shift: int) -> pa.Array:
    short = lines.length - diff
    lo, hi = segment * short // (max_edits + 1), (segment + 1) * short // (max_edits + 1)
    at = lo + shift
    ok = lines.fuzzy & (short > 0) & (at >= 0) & (at + hi - lo <= lines.length)
    begin = lines.at(np.where(ok, lines.first + at, 0))
    stop = lines.at(np.where(ok, lines.first + at + hi - lo, 0))
    h = K.xxh64(lines.data, begin, stop - begin, 42)
    with np.errstate(over="ignore"):
        h = (h ^ (short.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(segment)
    return pa.array(h.view(np.int64), mask=~ok)


def _scan(docs: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in K.blocks(rows.column(1)):
                yield make(texts, rows.column(0).slice(a, b - a))
    return two(docs).where("text is not null").mapInArrow(run, schema)


def occurrences(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, whole, line, h1, h2`` of every comparable line; ``whole`` is a hash of its text."""
    def make(texts, ids):
        lines = Lines(texts, rule)
        whole = K.xxh64(lines.data, *lines.text).view(np.int64)[lines.doc]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(lines.doc)), *map(pa.array, (whole, lines.number, *lines.ids()))],
                                          names=["doc_id", "whole", "line", "h1", "h2"])
    return _scan(docs, "doc_id long, whole long, line long, h1 long, h2 long", make)


def _distinct(docs: DataFrame, specs: list, rule: Rule) -> DataFrame:
    """Distinct lines: ``h1, h2, n`` and their names ``k0, k1, ...`` (all copies have the same)."""
    columns = ["h1", "h2", *(f"k{i}" for i in range(len(specs)))]

    def make(texts, _):
        lines = Lines(texts, rule)
        return pa.RecordBatch.from_arrays([*map(pa.array, lines.ids()), *(_name(lines, rule.edits, *s) for s in specs)], names=columns)
    return (_scan(docs, ", ".join(f"{c} long" for c in columns), make).groupBy("h1", "h2")
            .agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in columns[2:]]))


def _texts(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``id, body`` of the wanted distinct lines, from another pass over the texts that sends on little else."""
    wanted = write(wanted.select("id.h1", "id.h2").distinct(), "wanted")
    likely = sketch(wanted, "h1")

    def make(texts, _):
        lines = Lines(texts, rule)
        h1, h2 = lines.ids()
        some = np.flatnonzero(likely.holds(h1))
        _, first = np.unique(np.stack([h1[some], h2[some]]), axis=1, return_index=True)
        first = some[first]
        body = [lines.data[s:e].tobytes() for s, e in zip(lines.start[first], lines.end[first], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(h1[first]), pa.array(h2[first]), pa.array(body, pa.binary())], names=["h1", "h2", "body"])
    found = _scan(docs, "h1 long, h2 long, body binary", make).join(wanted.hint("merge"), ["h1", "h2"], "left_semi")
    return write(found.groupBy("h1", "h2").agg(F.first("body").alias("body")).select(F.struct("h1", "h2").alias("id"), "body"), "line-texts")


def _units(body: bytes, characters: bool) -> bytes | str:
    return body.decode("utf-8", "surrogateescape") if characters else body


def _inner(a: bytes | str, b: bytes | str) -> tuple[bytes | str, bytes | str]:
    """Both without their common beginning and end, found by halving."""
    for ends in (False, True):
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if (a[len(a) - mid:len(a) - lo] == b[len(b) - mid:len(b) - lo]) if ends else (a[lo:mid] == b[lo:mid]):
                lo = mid
            else:
                hi = mid - 1
        a, b = (a[:len(a) - lo], b[:len(b) - lo]) if ends else (a[lo:], b[lo:])
    return a, b


def within(a: bytes | str, b: bytes | str, limit: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``limit`` edits apart: bit-parallel, in a band of diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    a, b = _inner(a, b)
    if not a or limit == 0:
        return len(b) <= limit
    if limit == 1:
        return len(a) == len(b) == 1
    # Bit t of the vectors is row j - limit + t of column j, so that the band moves down with the columns.
    width = 2 * limit + 1
    full = (1 << width) - 1
    rows: dict[int, int] = {}
    for i in range(min(limit, len(a))):
        rows[a[i]] = rows.get(a[i], 0) | 1 << (i + limit + 1)
    up, down = full & ~((1 << limit) - 1), 0
    score = limit
    for j, ch in enumerate(b, 1):
        rows = {c: m >> 1 for c, m in rows.items() if m >> 1}
        i = j + limit - 1
        if i < len(a):
            rows[a[i]] = rows.get(a[i], 0) | 1 << (width - 1)
        match = rows.get(ch, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        score += 0 if diagonal >> (width - 1) & 1 else 1
        up = (right_down | ~((diagonal >> 1) | right_up)) & full
        down = (diagonal >> 1) & right_up
        if j & 15 == 0:
            # The least value in the band can no longer fall: give up where it is over the limit.
            value = least = score
            for t in range(width - 1, 0, -1):
                value += (down >> (t - 1) & 1) - (up >> (t - 1) & 1)
                least = min(least, value)
            if least > limit:
                return False
    for t in range(width - 1, limit + len(a) - len(b), -1):
        score += (down >> (t - 1) & 1) - (up >> (t - 1) & 1)
    return score <= limit


def _verified(pairs: DataFrame, bodies: DataFrame, limit: int, characters: bool) -> DataFrame:
    """The candidate pairs ``a, b`` whose bytes or characters are within ``limit``."""
    met = (pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("left")), "a")
           .join(bodies.select(F.col("id").alias("b"), F.col("body").alias("right")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sides = [[_units(x, characters) for x in rows.column(i).to_pylist()] for i in (4, 5)]
            ok = [within(x, y, limit) for x, y in zip(*sides, strict=True)]
            yield rows.filter(pa.array(ok, pa.bool_())).select([0, 1, 2, 3])
    flat = met.select("a.h1", "a.h2", F.col("b.h1").alias("g1"), F.col("b.h2").alias("g2"), "left", "right")
    kept = flat.mapInArrow(run, "h1 long, h2 long, g1 long, g2 long")
    return kept.select(F.struct("h1", "h2").alias("a"), F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2")).alias("b"))


_TABLES = np.random.default_rng(3).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = [0x9FB21C651E98DF25 | 1, 0xA24BAED4963EE407 | 1]


def _left_out(line: bytes | str) -> tuple[list[np.ndarray], list[np.uint64]]:
    """Two hashes of the line without each unit, and of the line itself, as polynomials over 2^64."""
    wide = isinstance(line, str)
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") if wide else np.frombuffer(line, np.uint8)
    without, whole = [], []
    for values, base in zip(_TABLES, _BASES, strict=True):
        powers = np.full(len(x), base, np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            known = values[x & 255] + (x >> 8).astype(np.uint64) * values[x >> 8 & 255] if wide else values[x]
            terms = known * np.cumprod(powers, dtype=np.uint64)
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            back = np.uint64(pow(base, -1, 1 << 64))
            without.append(prefix[:-1] + (prefix[-1] - prefix[1:]) * back)
        whole.append(prefix[-1])
    return without, whole


def _hot_links(bodies: DataFrame, characters: bool, edits: int = 1) -> DataFrame:
    """Candidate links of crowded lines: equal but for one unit, or equal to another without one; for more ``edits`` also
    equal once each has left out one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for h1, h2, body in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                line = _units(body, characters)
                (p, q), (w, v) = _left_out(line)
                n = len(line)
                place = np.concatenate([np.arange(n), np.full(n, -1), np.full(1, -1)])
                key = [np.concatenate([x, x, [y]]).astype(np.uint64).view(np.int64) for x, y in ((p, w), (q, v))]
                size = np.concatenate([np.full(n, n), np.full(n, n - 1), [n]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(size), pa.array(place), *map(pa.array, key), pa.array(np.full(2 * n + 1, h1)), pa.array(np.full(2 * n + 1, h2)),
                     pa.array(np.arange(2 * n + 1) == 2 * n)], names=["size", "place", "p", "q", "h1", "h2", "whole"])
    rows = bodies.select("id.h1", "id.h2", "body").mapInArrow(run, "size long, place long, p long, q long, h1 long, h2 long, whole boolean")
    rows = rows.withColumn("id", F.struct("h1", "h2")).drop("h1", "h2")
    key = ["size", "place", "p", "q"]
    # A place of -1 is a line with some unit left out; for one edit its centre is the line that it becomes.
    centre = F.when((F.col("place") >= 0) | F.col("whole") | F.lit(edits > 1), F.col("id"))
    centres = rows.groupBy(*key).agg(F.min(centre).alias("b"), F.count("*").alias("n")).where("n > 1 and b is not null")
    return rows.join(centres.hint("merge"), key).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _across(hot: DataFrame, roots: DataFrame, bodies: DataFrame, rule: Rule, bucket: int) -> DataFrame:
    """Candidate pairs ``a, b`` of crowded lines of different classes ``root``."""
    rows = write(hot.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "own", F.coalesce("root", "id").alias("root")), "crowd-roots")
    classes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = classes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("top"), F.count("*").alias("m")).where("m > 1")
    rows = write(rows.join(top.drop("m").hint("merge"), "key"), "crowd-names")
    if rule.edits == 2:
        split = rows.select("id", F.col("root.h1").alias("root")).distinct()
        lines = write(bodies.join(split, "id"), "crowd-lines")
        characters = rule.characters
        return families.pairs(lines, lambda body: _units(body, characters), rule.least, bucket)
    left = rows.where("root <> top").select("key", F.col("id").alias("a"), F.col("own").alias("mine"), F.col("root").alias("r"))
    right = rows.select("key", F.col("id").alias("b"), "own", "root")
    return left.join(right, "key").where("r <> root and (mine or own)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, distinct: DataFrame, rule: Rule, bucket: int = 64) -> DataFrame:
    """Verified links ``a, b`` between distinct lines (structs of two hashes)."""
    max_edits, characters = rule.edits, rule.characters
    specs = names(max_edits)
    named = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i <= max_edits).alias("own")) for i in range(len(specs))])
    rows = (distinct.select(F.struct("h1", "h2").alias("id"), F.explode(named).alias("k"))
            .select("id", "k.key", "k.own").where("key is not null"))
    met = write(rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("m")).where("n > 1 and m > 0"), "line-names")
    shared = write(rows.join(met.hint("merge"), "key"), "shared-names")
    cold = shared.where(F.col("n") <= bucket) if max_edits else shared
    left, right = cold.where("own").select("key", F.col("id").alias("a")), cold.select("key", F.col("id").alias("b"), "own")
    pairs = left.join(right, "key").where("a <> b and (a < b or not own)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = shared.where(F.col("n") > bucket) if max_edits else shared.limit(0)
    crowd = write(hot.select("id").distinct(), "crowd")
    bodies = _texts(docs, shared.select("id"), rule)
    if crowd.isEmpty():
        return _verified(pairs.distinct(), bodies, max_edits, characters)
    crowded = write(bodies.join(crowd.hint("merge"), "id", "left_semi"), "crowd-texts")
    near = _hot_links(crowded, characters, max_edits)
    if max_edits == 1:
        return _verified(pairs.union(near).distinct(), bodies, 1, characters)
    near = write(_verified(near, crowded, max_edits, characters), "near")
    pairs = pairs.union(_across(hot.select("key", "id", "own"), components(near), crowded, rule, bucket)).distinct()
    return _verified(pairs, bodies, max_edits, characters).union(near)


def removed(docs: DataFrame, max_edits: int = 1, min_bytes: int = MIN_BYTES, bucket: int = 64, characters: bool = False,
            exact: int | None = None) -> DataFrame:
    """``doc_id, whole, gone``: sorted numbers of the lines that go, for texts that lose any. With ``characters`` the
    edits and ``min_bytes`` count characters."""
    if max_edits < 0 or min_bytes <= max_edits:
        raise ValueError("max_edits must not be negative and be below min_bytes")
    if exact is not None and not 1 <= exact <= min_bytes:
        raise ValueError("exact must be positive and not above min_bytes")
    rule = Rule(max_edits, min_bytes, characters, exact)
    distinct = write(_distinct(docs, names(max_edits), rule), "lines")
    roots = components(links(docs, distinct, rule, bucket))
    classes = (distinct.where("n > 1").select(F.struct("h1", "h2").alias("node"))
               .join(roots, "node", "full").select("node.h1", "node.h2", F.coalesce("root", "node").alias("root")))
    marked = write(occurrences(docs, rule).join(write(classes, "classes").hint("merge"), ["h1", "h2"])
                   .select("doc_id", "whole", "line", "root"), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")
    # Written, so that the join shuffles both sides anew and can split a class with very many lines.
    heads = write(marked.groupBy("root").agg(F.min(order).alias("head")), "heads").hint("merge")
    gone = marked.join(heads, "root").where(order != F.col("head"))
    return write(gone.groupBy("doc_id", "whole").agg(F.array_sort(F.collect_set("line")).alias("gone")), "gone")


def deduplicate(docs: DataFrame, count: str | None = None, **settings) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text``; ``count`` names a column of how many went."""
    gone = removed(docs, **settings).select(F.col("doc_id").alias("__id"), F.col("whole").alias("__whole"), F.col("gone").alias("__gone"))
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__whole"])
    joined = docs.join(gone.hint("merge"), same, "left").drop("__id", "__whole")
    at, names_out = docs.columns.index("text"), [*docs.columns, *([count] if count else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = list(rows.columns)
            lost = [x or [] for x in columns.pop().to_pylist()]
            texts = columns[at].to_pylist()
            for i, numbers in enumerate(lost):
                if numbers:
                    out = set(numbers)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in out)
            columns[at] = pa.array(texts, pa.string())
            if count:
                columns.append(pa.array([len(x) for x in lost], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names_out)
    kind = T.StructType([*docs.schema.fields, *([T.StructField(count, T.LongType())] if count else [])])
    return joined.mapInArrow(run, kind)


def digest(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = deduplicate(two(docs).withColumn("n_lines", size), count="n_removed", **settings)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
