"""Exact deduplication by composable polynomial fingerprints, with a chunkwise comparison of what they call equal.

A text is taken in lower case (A-Z only) as UTF-8 bytes.

1. It is cut into chunks of ``chunk`` bytes, whose polynomial hashes to two prime moduli are taken side by side. Hashes
   of neighbours combine by arithmetic shifted by the length of the right one (``combine``), so a huge document is never hashed
   in one go. With its length the hash is the text's fingerprint.
2. Rows whose fingerprints are equal are compared by their chunks: a chunk, named by fingerprint and number, meets its
   like where they are grouped by content, and copies already go where they are read. A group of copies, however large,
   thus sends one row per task and chunk, and no row is longer than a chunk. Each text moves once at most.
3. A fingerprint whose chunk has two contents is a collision. Its rows are told apart by the SHA-256 of their texts.
4. Of a class of equal texts the row with the largest id stays. Classes and rows are counted by id before they are joined,
   through written tables, so that a hot class is a skewed join that adaptive execution splits.

Defined cases: null counts as empty, and empty texts are equal; very long texts go by chunks; a null id is smaller than
any other, and the largest id of a class without ids is null; of repeated rows that share the largest id one stays, so each
class keeps exactly one row; an empty table gives an empty table; other columns are ignored, or kept as they are by
``keep_last``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.tables import two, write

CHUNK = 1 << 16
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_327_217_885, 1_946_734_093)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Print = tuple[int, int, int]


def combine(left: Print, right: Print, moduli: tuple[int, int] = MODULI) -> Print:
    """The fingerprint of two neighbouring strings from theirs: two hashes and the length."""
    (a, b, n), (c, d, m) = left, right
    p, q = moduli
    return (a * pow(BASES[0] % p, m, p) + c) % p, (b * pow(BASES[1] % q, m, q) + d) % q, n + m


@cache
def _powers(base: int, modulus: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        step = min(done, count - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += step
    return out


class Chunks:
    """Chunks of a block of texts: ``data`` in lower case, the row, number, start and length of each, and its hashes."""

    def __init__(self, texts: list[bytes], chunk: int, moduli: tuple[int, int]):
        self.data = K.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        count = -(-size // chunk)
        self.row = np.repeat(np.arange(len(texts)), count)
        self.number = K.ragged(np.zeros(len(texts), np.int64), count)
        self.length = np.minimum(chunk, size[self.row] - self.number * chunk)
        self.stop = np.cumsum(self.length)
        self.hashes = []
        if len(self.row):
            behind = np.repeat(self.stop, self.length) - 1 - np.arange(len(self.data))
            value = self.data.astype(np.uint64) + np.uint64(1)
            for base, p in zip(BASES, moduli, strict=True):
                terms = value * _powers(base % p, p, chunk)[behind]
                self.hashes.append(np.add.reduceat(terms, self.stop - self.length) % np.uint64(p))

    def prints(self, rows: int, moduli: tuple[int, int]) -> list[Print]:
        """The fingerprint of each text."""
        out: list[Print] = [(0, 0, 0)] * rows
        if len(self.row):
            for row, number, a, b, n in zip(*(x.tolist() for x in (self.row, self.number, *self.hashes, self.length)), strict=True):
                out[row] = combine(out[row], (a, b, n), moduli) if number else (a, b, n)
        return out


def _packed(prints: list[Print]) -> tuple[pa.Array, pa.Array]:
    return pa.array([a << 31 | b for a, b, _ in prints], pa.int64()), pa.array([n for _, _, n in prints], pa.int64())


def fingerprints(docs: DataFrame, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``doc_id, print, n_bytes, text_sha256`` of every row; ``print`` holds both hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in K.blocks(rows.column(1)):
                made = _packed(Chunks(texts, chunk, moduli).prints(len(texts), moduli))
                sha = pa.array([hashlib.sha256(t.lower()).hexdigest() for t in texts])
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(a, b - a), *made, sha], names=["doc_id", "print", "n_bytes", "text_sha256"])
    return two(docs).mapInArrow(run, "doc_id long, print long, n_bytes long, text_sha256 string")


def chunks(docs: DataFrame, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``print, n_bytes, number, bytes``: the chunks of every text, named by its fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, _, texts in K.blocks(rows.column(1)):
                cut = Chunks(texts, chunk, moduli)
                if len(cut.row):
                    made = [x.take(pa.array(cut.row)) for x in _packed(cut.prints(len(texts), moduli))]
                    ends = np.concatenate([np.zeros(1, np.int64), cut.stop])
                    body = pa.Array.from_buffers(pa.large_binary(), len(cut.row), [None, pa.py_buffer(ends), pa.py_buffer(cut.data)])
                    yield pa.RecordBatch.from_arrays([*made, pa.array(cut.number), body.cast(pa.binary())], names=["print", "n_bytes", "number", "bytes"])
    return two(docs).mapInArrow(run, "print long, n_bytes long, number long, bytes binary")


def collisions(docs: DataFrame, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``print, n_bytes`` of the fingerprints that different texts share, by comparing all chunks of all texts."""
    contents = chunks(docs, chunk, moduli).distinct()
    several = contents.groupBy("print", "n_bytes", "number").count().where("count > 1")
    return several.select("print", "n_bytes").distinct()


def classes(docs: DataFrame, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """``doc_id, text_sha256, copies, keep_id, group_size``: each text and id once, with the rows that have both, and its
    class of equal texts: the largest id and the number of rows."""
    if chunk < 1 or chunk > 1 << 20:
        raise ValueError("chunk must be between 1 and 2^20 bytes")
    rows = fingerprints(docs, chunk, moduli).groupBy("print", "n_bytes", "text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    rows = write(rows, "prints")
    met = write(collisions(docs, chunk, moduli), "collisions").withColumn("met", F.lit(True))
    split = F.when(F.col("met"), F.col("text_sha256")).otherwise("").alias("split")
    key = ["print", "n_bytes", "split"]
    rows = write(rows.join(met, key[:2], "left").select(*key[:2], split, "text_sha256", "doc_id", "copies"), "rows")
    groups = write(rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return rows.join(groups.hint("merge"), key).select("doc_id", "text_sha256", "copies", "keep_id", "group_size")


def judge(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    rows = classes(docs, **settings).select("doc_id", "keep_id", "group_size", "text_sha256", copy)
    kept = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with one row of each class of equal texts, all columns as they are."""
    stay = classes(docs, **settings).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = write(stay.select("doc_id", "text_sha256", "copies"), "stay")
    inner = F.sha2(F.translate(F.coalesce(F.col("d.text").cast("string"), F.lit("")), _UPPER, _LOWER), 256)
    met = docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (inner == F.col("s.text_sha256")))
    rows = met.select(F.struct("d.*").alias("row"), F.col("s.doc_id").alias("id"), F.col("s.text_sha256").alias("sha"), F.col("s.copies").alias("n"))
    again = rows.where("n > 1").dropDuplicates(["id", "sha"])
    return rows.where("n = 1").unionByName(again).select("row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
