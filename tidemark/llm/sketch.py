"""A Bloom filter of fixed size over 64-bit hashes, so that a scan sends on little but what a join wants.

It is made by a grouped sum and has the same size whatever it holds (``BITS`` bits, 8 MB at most on the driver and in each task). It lets
through every wanted hash, and few others up to some ten million; beyond that ever more, so a join must follow. The plan is the
same at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


class Sketch:
    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be wanted."""
        h = hashes.view(np.uint64)
        out = np.ones(len(h), bool)
        for shift in (0, 32):
            at = (h >> np.uint64(shift)) & np.uint64(BITS - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def sketch(wanted: DataFrame, column: str) -> Sketch:
    """The filter of a column of hashes (longs)."""
    places = F.array(*[F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(BITS - 1)) for shift in (0, 32)])
    rows = wanted.select(F.explode(places).alias("at"))
    word = F.shiftright("at", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    table: pa.Table = rows.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(BITS // 64, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Sketch(words)
