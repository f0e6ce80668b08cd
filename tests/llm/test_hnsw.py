"""Nearest neighbours against all distances."""

import numpy as np
import pytest

from tidemark.llm import hnsw

INF, NAN = float("inf"), float("nan")


def brute(rows, k, every=1):
    ok = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in ok:
        if i % every == 0:
            far = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = far[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(300 + i, [0.0, 0, 0, 0, float(i + 1)]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 5), (2003, [1.0, None, 0, 0, 0]), (2004, [NAN, 1, 1, 1, 1]), (2005, [INF, 1, 1, 1, 1]), (None, [1.0] * 5),
             (2006, [1.0, 2.0]), (2007, [1.0, 2.5]), (2008, [3.0]), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    for shard in (8192, 60):
        got = {}
        for r in hnsw.neighbours(df, k=10, shard_rows=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
            assert r.rank == len(got[r.query_id])
        want = {i: v for i, v in brute(rows, 10).items() if v}
        assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
        assert all(np.allclose([s for s, _ in got[i]], [s for s, _ in want[i]], rtol=1e-12) for i in want)
    assert hnsw.neighbours(df.limit(0)).count() == 0
    assert hnsw.neighbours(df.where("vec_id = 2008")).count() == 0


@pytest.mark.parametrize("scale", ["clusters", "uniform", "line"])
def test_recall(scale):
    rng = np.random.default_rng(1)
    x = {"clusters": rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)] * 4 + rng.normal(size=(3000, 24)), "uniform": rng.uniform(size=(3000, 32)),
         "line": np.arange(3000.0)[:, None] * np.ones((1, 3))}[scale].astype(np.float32)
    layers = hnsw.build(x)
    assert [len(a) for a, _ in layers][0] == 3000 and all((b < 3000).all() for _, b in layers)
    q = x[::37]
    found = hnsw.search(x, layers, q, 10)
    far = ((q[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(2)
    best = np.sort(far, 1)[:, 9]
    hits = (far[np.arange(len(q))[:, None], found] <= best[:, None] + 1e-9).mean()
    assert hits >= 0.95


def test_registered_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = brute(rows, 10, 100)
    got = {}
    for r in hnsw.neighbours(table, hnsw.hundredth(table), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & {j for _, j in want[i]}) / 10 for i in want]) >= 0.9
