"""Boosted trees on all training rows: groups too large for a task against the same fit in one, and none of the rows left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, boosting_blocks
from tidemark.operators.boosting import Booster
from tidemark.sources.workspace import materialise

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(7), []
    for fold, n in ((1, 1100), (2, 1900)):
        for i in range(n):
            x = [*rng.normal(size=3), float(rng.integers(0, 3)), rng.choice([-2.5, 0.0, 7.0]), float("nan")]
            for f in range(4):
                if rng.random() < 0.15:
                    x[f] = float("nan")
            one = int(rng.random() < 1 / (1 + np.exp(-np.nan_to_num(x[0]) * 2 - np.nan_to_num(x[3]))))
            two = None if i % 9 == 0 else int(rng.random() < 0.2 + 0.3 * (x[4] > 0))
            out.append((fold, "val" if i % 4 == 0 else "train", i, *[None if np.isnan(v) else float(v) for v in x], one, two, float(rng.choice([0.5, 1.0, 2.0]))))
    frame = spark.createDataFrame(out, "fold int, role string, row_id int, " + ", ".join(f"{c} double" for c in NAMES) + ", one int, two int, weight double").repartition(3)
    frames = [(k, frame.where(f"fold = {k}").drop("fold")) for k in (1, 2)]
    return boosting.table(frames, {1: NAMES, 2: NAMES}, ["one", "two"], ["row_id"], "weight")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    # Records and steps of few rows, so that a fold has many of them.
    monkeypatch.setattr(boosting_blocks, "_RECORD", 128)
    monkeypatch.setattr(boosting_blocks, "_STEP", 300)


def held(rows, fold, label):
    part = [r for r in rows.collect() if r.fold == fold and r.role == "train" and r[f"y_{label}"] is not None]
    return np.array([r.x for r in part], np.float32), np.array([r[f"y_{label}"] for r in part]), np.array([r.w for r in part])


def same(one, two):
    assert one.keys() == two.keys()
    for k in one:
        assert len(one[k]) == len(two[k])
        for a, b in zip(one[k], two[k]):
            assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "threshold", "value"))


def test_split_points_are_those_of_all_values(rows):
    train = rows.where("role = 'train'")
    for bins in (8, 64):
        found = boosting_blocks.exact_edges(train, bins)
        for fold in (1, 2):
            x = np.array([r.x for r in train.where(F.col("fold") == fold).collect()], np.float32)
            for got, want in zip(found[fold], boosting._edges(x, bins), strict=True):
                assert np.array_equal(got, want)


@pytest.mark.parametrize("settings", [{}, {"balanced": True}, {"depth": 6, "least": 150}])
def test_blocks_grow_the_trees_of_all_rows(rows, settings, monkeypatch):
    s = Booster(rate=0.2, rows=1.0, columns=1.0, bins=16, **{"depth": 4, "least": 20, **settings})
    rounds = {(f, y): 6 for f in (1, 2) for y in ("one", "two")}
    made, plain = boosting.fit(rows, ["one", "two"], s.but(task_rows=100), validate=False, rounds=rounds).trees, boosting._edges
    for (fold, label), trees in made.items():
        x, y, w = held(rows, fold, label)
        # Split points are those of the fold's rows, whether a label is known or not.
        whole = held(rows, fold, "one")[0]
        own = plain(whole, 16)
        monkeypatch.setattr(boosting, "_edges", lambda x, bins: own)
        want = boosting.grow_block(x, y, w, [], s, 1, 6)
        assert len(trees) == 7
        total = lambda ts: np.sum([t.margins(x) for t in ts], axis=0)
        assert np.allclose(total(trees[:2]), total(want[:2]), atol=1e-7)
        assert np.allclose(total(trees), total(want), atol=1e-6)


def test_tasks_passes_and_other_orders_agree(rows):
    s = Booster(rounds=7, patience=7, rate=0.2, least=10, bins=16, task_rows=100, block=7)
    labels = ["one", "two"]
    tasks = boosting.fit(rows, labels, s)
    passes = boosting.fit(rows, labels, s.but(block_bytes=0))
    mixed = boosting.fit(rows.repartition(7, "row_id"), labels, s.but(block_bytes=100_000, block=4))
    assert tasks.report == passes.report and [r[:4] for r in tasks.report] == [r[:4] for r in mixed.report]
    same(tasks.trees, passes.trees)
    same(tasks.trees, mixed.trees)
    fixed = {(1, "one"): 2, (2, "one"): 6, (1, "two"): 5, (2, "two"): 1}
    some = [boosting.fit(rows, labels, s.but(block_bytes=b), validate=False, rounds=fixed).trees for b in (0, 1 << 20)]
    assert {k: len(v) - 1 for k, v in some[0].items()} == fixed
    same(*some)
    with pytest.raises(ValueError):
        boosting.fit(rows.withColumn("y_two", F.lit(None).cast("double")), labels, s)


def test_rows_are_drawn_by_tree_and_share(rows):
    s = Booster(rows=0.5, task_rows=100)
    train = materialise(rows.where("role = 'train' and fold = 2"), "test")
    coded = boosting_blocks.Coded(train, {2: train.count()}, ["one"], s)
    starts = sorted((r.start, r.n) for r in coded.records.collect())
    assert [a for a, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()] and sum(n for _, n in starts) == train.count()
    block = boosting_blocks.Block(coded.shapes[2], np.zeros((6, sum(n for _, n in starts)), np.uint8), starts, np.ones(1))
    one, two = block.drawn(s, 1), block.drawn(s, 2)
    assert abs(one.mean() - 0.5) < 0.06 and abs((one == two).mean() - 0.5) < 0.06


def test_no_training_row_is_left_out(spark):
    """A fold of more than 100,000 rows: all are written and fitted."""
    n = 130_000
    frame = spark.range(n + 100).select(F.col("id").alias("row_id"), F.when(F.col("id") < n, "train").otherwise("val").alias("role"),
                                        (F.col("id") % 1000 / 8).alias("f0"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("f1"),
                                        (F.pmod(F.xxhash64("id"), F.lit(11)) < 3).cast("int").alias("y"))
    s = Booster(rounds=1, patience=1, rows=1.0, columns=1.0, depth=2)
    table = boosting.table([(1, frame)], {1: ["f0", "f1"]}, ["y"], ["row_id"], roles=["train", "val"], sample=s)
    assert table.where("role = 'train'").count() == n
    tree = boosting.fit(table, ["y"], s).trees[1, "y"][0]
    share = frame.where("role = 'train'").agg(F.avg("y")).first()[0]
    assert np.isclose(tree.value[0], np.log(share / (1 - share)), atol=1e-12)
