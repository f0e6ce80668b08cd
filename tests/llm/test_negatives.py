"""Hard negatives against all scores, and the intervals against the scores they must hold."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, v int, rank int"


def whole(v):
    most = (1 << 31) - 1
    return [max(-most, min(most, math.floor(256.0 * x))) for x in v]


def brute(rows, is_anchor, positives=5, k=3, low=50, high=95):
    known = {(i, tuple(whole(v)), c) for i, v, c in rows if i is not None and c is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)}
    top = (1 << 63) - 1
    out = []
    for i, v, c in known:
        if not is_anchor(i):
            continue
        near = sorted((-max(-top - 1, min(top, sum(x * y for x, y in zip(v, w)))), j, d) for j, w, d in known if j != i and len(w) == len(v))
        for s, j, d in [x for x in near if x[2] == c][:positives]:
            fits = [x for x in near if x[2] != c and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, rank + 1, m, -s, -t) for rank, (t, m, _) in enumerate(fits[:k])]
    return sorted(out)


def random_rows(rnd, n, dim, labels=3):
    base = [[rnd.gauss(0, 0.2) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(base)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("dim", [0, 1, 3, 64, 100, 200])
def test_intervals_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    v = np.concatenate([rng.integers(-90, 90, (200, dim)), np.zeros((2, dim), int), rng.integers(-_BIG, _BIG, (20, dim))])
    q = np.concatenate([v[:40], np.zeros((1, dim), int), v[-3:]])
    lower, upper = negatives.intervals(q, *negatives.encode(v))
    a, r = (x.ravel() for x in np.indices(lower.shape))
    exact = negatives.scores(q, v, a, r).reshape(lower.shape)
    assert (lower <= exact).all() and (exact <= upper).all()
    if dim >= 64:  # they are narrower than what the norms alone allow
        norms = np.sqrt((q[:40] ** 2).sum(1))[:, None] * np.sqrt((v[:200] ** 2).sum(1))
        assert (upper - lower)[:40, :200].mean() < 0.75 * 2 * norms.mean()


_BIG = 1 << 24


def test_scores_beyond_a_long():
    big = np.full((1, 4), (1 << 31) - 1)
    assert negatives.scores(big, np.concatenate([big, -big, big // 2]), np.zeros(3, int), np.arange(3)).tolist() == [
        (1 << 63) - 1, -(1 << 63), 4 * ((1 << 31) - 1) * (((1 << 31) - 1) // 2)]


def test_rotation_keeps_lengths():
    for size in (64, 128):
        r = negatives.rotation(size)
        assert np.allclose(r @ r.T, np.eye(size), atol=1e-12) and np.array_equal(r, negatives.rotation(size))


@pytest.mark.parametrize(("row_block", "anchor_block", "dim"), [(4096, 4096, 64), (40, 7, 64), (100, 100, 5), (60, 30, 70)])
def test_against_all_scores(spark, row_block, anchor_block, dim):
    rnd = random.Random(dim + row_block)
    rows = random_rows(rnd, 300, dim)
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(60)]  # a common vector with every label
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[6][1], 2), (2000, None, 1), (2005, rows[7][1], None), (2010, [None] * dim, 1), (None, rows[8][1], 1),
             (2015, [float("nan")] * dim, 1), (2020, [float("inf")] * dim, 1), (2025, [0.0] * dim, 1), (2030, [], 1), (2035, [], 1), (2040, [1.0, 2.0], 0),
             (2045, [x * 3 for x in rows[9][1]], 2), (2050, [-x for x in rows[9][1]], 2)]
    vectors = spark.createDataFrame([(i, v, c, "x", 1, 2) for i, v, c in rows], SCHEMA).repartition(4)
    got = negatives.mine(vectors, F.col("vec_id") % 5 == 0, row_block=row_block, anchor_block=anchor_block)
    want = brute(rows, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_other_parameters_and_ties(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(-1, 2) / 256 for _ in range(8)], rnd.randrange(2)) for i in range(200)]
    vectors = spark.createDataFrame([(i, v, c, "x", 1, 2) for i, v, c in rows], SCHEMA)
    got = negatives.mine(vectors, F.col("vec_id") < 20, positives=2, k=9, low=10, high=100, row_block=64)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i < 20, 2, 9, 10, 100)


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("vec_id") >= 0).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0], 1, "", 0, 0), (2, [1.0, 2.0], 2, "", 0, 0)], SCHEMA)
    assert negatives.mine(few, F.col("vec_id") >= 0).count() == 0


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.execute(negatives.ORACLE).fetchall()
    got = catalog.QUERIES["op13_negatives"](spark, sf_dir)
    assert got.columns == [x[0] for x in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
