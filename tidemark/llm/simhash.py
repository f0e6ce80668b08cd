"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_bits // 2 + 1`` segments. Two fingerprints that differ in at
most ``max_bits`` bits then share a segment up to one bit, so they share one of its one-wildcard
variants (the segment with one bit masked, and which bit). Variants are grouped by an equality
key, candidates that meet in one are verified by their Hamming distance.

Copies collapse first: links are sought between distinct fingerprints. A variant shared by more
than ``bucket`` of them would emit the square of its size in pairs; there the members are linked
through ball centres instead: each fingerprint names itself and its 64 one-bit neighbours, and all
that name the same centre are within two bits of each other. That is exact, needs 65 rows each and
never pairs.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; one or two words
are one shingle; repeated rows are one group; a row with a null id has the component of its
group, null if no row there has an id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.components import components
from tidemark.llm.tables import two, write

_OUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])
_LANES = np.uint64(0x0101010101010101)


def fingerprint_block(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Unsigned fingerprints of a block of texts."""
    w = K.Words(texts, K.SPACES)
    n = np.where(w.count >= shingle, w.count - shingle + 1, np.minimum(w.count, 1))
    head = K.ragged(w.first, n)
    span = np.repeat(np.minimum(w.count, shingle), n)
    out = np.zeros(len(texts), np.uint64)
    if not len(head):
        return out
    h = K.xxh64(w.data, w.start[head], w.end[head + span - 1] - w.start[head])
    # Sums of bits: eight byte lanes per word, in runs of at most 255 so that no lane overflows.
    some = np.flatnonzero(n)
    runs = (n[some] + 254) // 255
    inner = K.ragged(np.zeros(len(some), np.int64), runs) * 255
    begin = np.repeat((np.cumsum(n) - n)[some], runs) + inner
    ends = np.cumsum(runs) - runs
    half = n[some] / 2
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, begin)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), ends, axis=0)
        for j in range(8):
            out[some] |= (ones[:, j] > half).astype(np.uint64) << np.uint64(8 * j + b)
    return out


def _named(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_key, fp`` (the 64 bits as a signed long) of every whole text; the key is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts = [fingerprint_block(texts, shingle) for _, _, texts in K.blocks(rows.column(2))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield K.batch(_OUT, rows.column(0), rows.column(1), fp.view(np.int64))
    return two(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, fp long")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every whole text."""
    return _named(docs, shingle).select("doc_id", "fp")


def _variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp, bit, value``: the segment around each bit with that bit masked."""
    cuts = max_bits // 2 + 1
    edges = [round(64 * i / cuts) for i in range(cuts + 1)]
    rows = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        mask = (1 << hi) - (1 << lo)
        for bit in range(lo, hi):
            keep = mask & ~(1 << bit)
            rows.append(F.struct(F.lit(bit).cast("byte").alias("bit"),
                                 F.lit(keep - (1 << 64) if keep >> 63 else keep).cast("long").alias("keep")))
    return (fps.select("fp", F.explode(F.array(*rows)).alias("v"))
            .select("fp", "v.bit", F.col("fp").bitwiseAND(F.col("v.keep")).alias("value")))


def links(fps: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """Links ``a, b`` with the components of all pairs of distinct ``fp`` within ``max_bits``.

    ``bucket`` bounds the variants that are paired; larger ones go by ball centres, which is exact
    for ``max_bits`` of 2. For any other threshold all buckets are paired.
    """
    if not 0 <= max_bits <= 64:
        raise ValueError("max_bits must be between 0 and 64")
    variants, key = _variants(fps, max_bits), ["bit", "value"]
    # Which variants are shared is counted first, in a sum that a hot one cannot skew; the members
    # follow by a merge join, which adaptive execution splits, so the plan is the same at any size.
    met = write(variants.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "variants")
    shared = write(variants.join(met.hint("merge"), key).select("fp", *key, "n"), "shared")
    paired = shared if max_bits != 2 else shared.where(F.col("n") <= bucket)
    near = (paired.select(*key, F.col("fp").alias("a")).join(paired.select(*key, F.col("fp").alias("b")), key)
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b").distinct())
    if max_bits != 2:
        return near
    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long")
                                             for b in range(64)])
    balls = (hot.select("fp", F.explode(flips).alias("flip"))
             .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")))
    low = balls.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    return near.union(balls.join(low.select("centre", "b"), "centre").where("fp <> b")
                      .select(F.col("fp").alias("a"), "b")).distinct()


def _classes(fps: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """``fp, root, component_id`` of ``fp, least``: each distinct fingerprint's class and the smallest id there."""
    least = write(fps, "distinct")
    roots = components(links(least.select("fp"), max_bits, bucket))
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return write(placed.join(first, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links, one row per row."""
    prints = write(fingerprints(docs, shingle), "fingerprints")
    where = _classes(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits, bucket)
    return prints.join(where, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """The documents with one row of each component: that of its smallest id, ids before none.

    A row is told by its id and its text, so rows that share an id are judged each on its own; of rows that share both one stays.
    """
    prints = write(_named(docs, shingle), "fingerprints")
    where = _classes(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits, bucket)
    # One row for each text and id, so that a hot one is counted before the join.
    rows = write(prints.groupBy("fp", "doc_id", "text_key").agg(F.count("*").alias("copies")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "copies")
    heads = rows.join(where.hint("merge"), "fp").groupBy("root").agg(F.min(order).alias("head"))
    heads = write(heads.select("head.doc_id", "head.text_key", "head.copies"), "heads")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("h.text_key"))
    met = docs.alias("d").join(heads.alias("h"), same).select(F.struct("d.*").alias("row"), F.col("h.doc_id").alias("id"), F.col("h.text_key").alias("key"), "h.copies")
    again = met.where("copies > 1").dropDuplicates(["id", "key"])
    return met.where("copies = 1").unionByName(again).select("row.*")
