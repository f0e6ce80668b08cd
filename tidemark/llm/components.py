"""Connected components of a link table, by alternating star contraction.

Each round rewrites the links twice: every node's larger neighbours, then its smaller ones, are
linked to the smallest node seen. Rounds grow with the logarithm of the longest chain. Every round
is a written table, so a lost executor costs one stage; nothing but two numbers per round reaches
the driver. Minima are grouped before they are joined back, so a hub is an ordinary skewed join,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import drop, write


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, root)``, root being the smallest node reachable.

    Nodes without a link to another node do not appear. Null ends and self links are ignored,
    repeated links count once; an empty table gives an empty table.
    """
    edges = write(_oriented(links), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == seen:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        seen = state
        following = write(_small_star(_large_star(edges)), "links")
        drop(edges)
        edges = following


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links with the larger end first."""
    return (links.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return (both.join(low, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    rest = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _oriented(rest.union(low.select("a", F.col("low").alias("b"))))
