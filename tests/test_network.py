"""The hazard network: gradients against differences, passes against one-task sums, early stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import network
from tidemark.operators.blending import share


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net = network.Network.start(4, (6, 5), 1)
    x, z, w = rng.normal(size=(30, 4)), (rng.random((30, 3)) < 0.3).astype(float), np.array([3.0, 1.0, 25.0])
    flat = net.flat() + rng.normal(0, 0.05, net.flat().size)
    loss, got = net.like(flat).gradient(x, z, w)
    for i in range(0, flat.size, 5):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        up, down = (net.like(flat + s).gradient(x, z, w)[0] for s in (step, -step))
        assert (up - down) / 2e-5 == pytest.approx(got[i], rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for fold in (1, 2):
        x = rng.normal(size=(700, 3))
        z = x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=700)
        for i in range(700):
            y = [float(z[i] > t) for t in (1.6, 1.0, 0.6)]
            out.append((fold, i < 500, x[i].tolist(), y, i))
    return spark.createDataFrame(out, "fold int, train boolean, x array<double>, y array<double>, row_id int").repartition(6)


def test_partition_sums_equal_one_pass(spark, rows):
    nets = {f: network.Network.start(3, (8,), f) for f in (1, 2)}
    weights = {1: np.array([2.0, 5.0, 1.0]), 2: np.ones(3)}
    every = rows.collect()
    for f, (sums, hist) in network._pass(rows, nets, weights).items():
        part = [r for r in every if r.fold == f and r.train]
        y = np.array([r.y for r in part])
        loss, g = nets[f].gradient(np.array([r.x for r in part]), np.diff(y, axis=1, prepend=0), weights[f])
        assert np.allclose(sums, np.concatenate([[loss, len(part)], g]))
        val = [r for r in every if r.fold == f and not r.train]
        p = nets[f].cumulative(np.array([r.x for r in val]))
        assert (np.diff(p, axis=1) >= 0).all()
        y = np.array([r.y for r in val])
        assert hist[:, -1] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(0))


def test_fit_stops_by_patience_and_beats_the_start(spark, rows):
    nets, report = network.fit(rows, (16, 8), rate=0.02, steps=40, patience=8)
    weights = {f: np.ones(3) for f in nets}
    start = {f: network.Network.start(3, (16, 8), 42) for f in nets}
    for f, steps, best, score in report:
        assert steps == 40 or steps - best >= 8
        assert share(network._pass(rows, nets, weights)[f][1]) == pytest.approx(score)
        assert score > share(network._pass(rows, start, weights)[f][1]) + 0.01
    got = network.score(rows.where("not train"), nets, ["a", "b", "c"], ["row_id"]).toPandas()
    assert len(got) == 400 and (got.a <= got.b).all() and (got.b <= got.c).all()


def test_class_weights_are_capped_and_rows_not_copied(spark, rows):
    rare = rows.withColumn("y", F.when(F.col("row_id") % 100 == 0, F.array(*[F.lit(1.0)] * 3)).otherwise(F.array(*[F.lit(0.0)] * 3)))
    seen = {}
    real = network._pass
    try:
        network._pass = lambda r, n, w: seen.update(w) or real(r, n, w)
        network.fit(rare, (4,), steps=1)
    finally:
        network._pass = real
    assert all(w.tolist() == [25.0, 1.0, 1.0] for w in seen.values())


def test_packed_rows_are_the_rows(spark, rows):
    got = {}
    for batch in network.packed(rows).toArrow().combine_chunks().to_batches():
        assert max(len(b) for b in batch.column("y").to_pylist()) <= network._RECORD * 3 * 8
        for f, train, x, y in network._runs(batch):
            got.setdefault((f, train), []).extend(map(tuple, np.hstack([x, y]).tolist()))
    want = {}
    for r in rows.collect():
        want.setdefault((r.fold, r.train), []).append((*r.x, *r.y))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    nets, weights = {f: network.Network.start(3, (8,), f) for f in (1, 2)}, {f: np.ones(3) for f in (1, 2)}
    plain, short = network._pass(rows, nets, weights), network._pass(network.materialise(network.packed(rows), "packed"), nets, weights)
    assert all(np.allclose(a, b) for f in nets for a, b in zip(plain[f], short[f]))


def test_passes_read_packed_rows(spark, rows, monkeypatch):
    seen, real = [], network._pass
    monkeypatch.setattr(network, "_pass", lambda r, n, w: seen.append(dict(r.dtypes)["x"]) or real(r, n, w))
    network.fit(rows, (4,), steps=2)
    assert seen and set(seen) == {"binary"}
