"""What keeps a run in bounds as its tables grow: rows that are written, read again or emitted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import Booster


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [("train" if i < 1500 else "val", i, *map(float, rng.normal(size=3)), int(rng.random() < 0.4)) for i in range(2000)]
    return spark.createDataFrame(rows, "role string, row_id int, f0 double, f1 double, f2 double, y int")


def test_a_fit_writes_only_the_training_rows_that_it_draws(frame):
    s = Booster(rounds=6, patience=6, block=3, depth=3, most_rows=400)
    settings = [(1, frame)], {1: ["f0", "f1", "f2"]}, ["y"], ["row_id"]
    every, drawn = boosting.table(*settings), boosting.table(*settings, roles=["train", "val"], sample=s)
    counts = {r["role"]: r["n"] for r in drawn.groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert counts["val"] == 500 and 300 < counts["train"] < 500
    assert boosting.table(*settings, roles=["val"]).count() == 500
    one, two = (boosting.fit(t, ["y"], s) for t in (every, drawn))
    assert one.report == two.report
    for a, b in zip(one.trees[1, "y"], two.trees[1, "y"], strict=True):
        assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "threshold", "value"))


def test_leaves_are_those_of_a_walk_down_the_tree():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (333, 6)).astype(np.float32)
    x[rng.random(x.shape) < 0.2] = np.nan
    for depth in (1, 3, 9):
        inner = (1 << depth) - 1
        tree = boosting.Tree(rng.integers(0, 6, inner).astype(np.int32), rng.choice([0, 1, 2, np.inf], inner).astype(np.float32), rng.normal(size=inner + 1))
        found = []
        for row in x:
            at = 0
            while at < inner:
                at = 2 * at + (1 if row[tree.feature[at]] <= tree.threshold[at] else 2)
            found.append(at - inner)
        assert tree.leaves(boosting.Columns(x)).tolist() == found


def test_rows_are_shuffled_by_person_before_they_grow(spark, sf_dir, monkeypatch):
    from tidemark.config import MINIMAL
    from tidemark.operators import lookback
    from tidemark.plans import matrix
    from tidemark.sources.training_log import TrainingLog
    log, seen = TrainingLog(spark, sf_dir), []
    groups = MINIMAL.but(recency=True, quality=True)
    for name in ("recency_intensity", "topic_novelty"):
        own = getattr(lookback, name)
        monkeypatch.setattr(lookback, name, lambda probe, history, own=own: seen.append(probe.columns) or own(probe, history))
    matrix.transform(log.train, matrix.fit(log.prior, log.train, groups), groups)
    assert len(seen) == 2 and all("gender_code" not in c and "trainer_encoded" not in c for c in seen)
