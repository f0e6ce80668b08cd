"""Boosted trees against plain versions: splits, prefixes, blocks, patience, stored models."""

import numpy as np
import pytest

from tidemark.operators import boosting
from tidemark.operators.boosting import Booster, Tree


def data(n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).astype(np.float32)
    x[rng.random((n, 5)) < 0.1] = np.nan
    z = np.where(np.nan_to_num(x[:, 0], nan=1.0) > 0.2, 1.5, -1.0) + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2])
    return x, (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)


def test_first_split_is_the_best_of_all():
    x, y = data(300)
    s = Booster(depth=1, least=10, columns=1.0, rows=1.0, bins=64, rate=1.0)
    base, tree = boosting.grow_block(x, y, np.ones(len(y)), [], s, 1, 1)
    p = 1 / (1 + np.exp(-base.value[0]))
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.ridge)
    best = max(gain(x[:, f] <= t) + gain(~(x[:, f] <= t)) for f in range(5) for t in [*boosting._edges(x, 64)[f], np.inf]
               if 10 <= (x[:, f] <= t).sum() <= len(y) - 10)
    left = x[:, tree.feature[0]] <= tree.threshold[0]
    assert np.isclose(gain(left) + gain(~left), best)
    assert np.allclose(tree.value, [-g[left].sum() / (h[left].sum() + s.ridge), -g[~left].sum() / (h[~left].sum() + s.ridge)])


def test_margins_follow_the_tree_and_frozen_nodes_have_one_value():
    x, y = data(400)
    s = Booster(depth=5, least=60, columns=0.8, rows=1.0)
    for tree in boosting.grow_block(x, y, np.ones(len(y)), [], s, 1, 4):
        for row, got in zip(x[:60], tree.margins(x[:60])):
            at = 0
            while at < len(tree.feature):
                at = 2 * at + (1 if row[tree.feature[at]] <= tree.threshold[at] else 2)
            assert tree.value[at - len(tree.feature)] == got
        for node in np.flatnonzero(np.isinf(tree.threshold)):
            below = [node]
            while below[0] < len(tree.feature):
                below = [c for b in below for c in (2 * b + 1, 2 * b + 2)]
            known = x[~np.isnan(x).any(1)]
            reached = {v for v in tree.margins(known)}
            assert reached <= set(tree.value.tolist())


def test_weights_count_like_copies():
    x, y = data(200)
    w = np.random.default_rng(3).integers(1, 4, len(y)).astype(float)
    s = Booster(depth=3, least=1, columns=1.0, rows=1.0, bins=256)
    one = boosting.grow_block(x, y, w, [], s, 1, 3)
    rep = np.repeat(np.arange(len(y)), w.astype(int))
    two = boosting.grow_block(x[rep], y[rep], np.ones(len(rep)), [], s, 1, 3)
    total = lambda trees: np.sum([t.margins(x) for t in trees], axis=0)
    assert np.allclose(one[0].value, two[0].value) and np.corrcoef(total(one), total(two))[0, 1] > 0.98


def test_fit_lowers_the_loss():
    x, y = data(3000)
    trees = boosting.grow_block(x[:2000], y[:2000], np.ones(2000), [], Booster(rate=0.1), 1, 80)
    margin = np.cumsum([t.margins(x[2000:]) for t in trees], axis=0)
    p = 1 / (1 + np.exp(-margin))
    loss = -(y[2000:] * np.log(p) + (1 - y[2000:]) * np.log(1 - p)).mean(1)
    assert loss[40] < loss[0] - 0.1


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for fold in (1, 2):
        x, y = data(900, fold)
        out += [(fold, "train" if i < 600 else "val", i, [None if np.isnan(v) else float(v) for v in a], int(b), int(b and a[0] > 0))
                for i, (a, b) in enumerate(zip(x, y))]
    names = [f"f{i}" for i in range(5)]
    table = spark.createDataFrame(out, "fold int, role string, row_id int, x array<double>, one int, two int").selectExpr(
        "fold", "role", "row_id", "one", "two", *[f"x[{i}] f{i}" for i in range(5)]).repartition(5)
    frames = [(k, table.where(f"fold = {k}").drop("fold")) for k in (1, 2)]
    return boosting.table(frames, {1: names, 2: names}, ["one", "two"], ["row_id", "one"])


def brute_losses(rows, trees, key):
    fold, label = key
    part = [r for r in rows.collect() if r.fold == fold and r.role == "val"]
    x, y = np.array([r.x for r in part], np.float32), np.array([r[f"y_{label}"] for r in part])
    margin = np.cumsum([t.margins(x) for t in trees], axis=0)
    p = np.clip(1 / (1 + np.exp(-margin)), .001, .999)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(1), margin, y


def test_patience_blocks_and_prefixes(spark, rows):
    s = Booster(rounds=60, patience=10, rate=0.2, block=25, least=10)
    fitted = boosting.fit(rows, ["one", "two"], s)
    again = boosting.fit(rows, ["one", "two"], s.but(block=7))
    whole = boosting.fit(rows, ["one", "two"], s.but(block=60))
    assert len(fitted.report) == 4
    for fold, label, grown, best, loss in fitted.report:
        key = fold, label
        for other in (again, whole):
            # Blocks of other lengths, and so other restarts, grow the same trees.
            assert [t.value.tolist() for t in other.trees[key]] == [t.value.tolist() for t in fitted.trees[key]]
        losses, _, _ = brute_losses(rows, fitted.trees[key], key)
        assert np.isclose(losses[-1], loss) and losses.argmin() == best == len(fitted.trees[key]) - 1
        assert grown == 60 or grown - best >= 10
        assert loss <= losses[min(20, len(losses) - 1)] + 1e-12


def test_auc_stages(spark, rows):
    s = Booster(rounds=20, patience=20, rate=0.2, block=20, least=10, by_auc=True)
    trees = boosting.fit(rows, ["one"], s.but(by_auc=False, patience=100)).trees
    trees = {k: v + [Tree(v[0].feature, v[0].threshold, np.zeros(1))] * 10 for k, v in trees.items()}
    for key, got in boosting.stage_losses(rows.where("role = 'val'"), trees, ranks=True).items():
        _, margin, y = brute_losses(rows, trees[key], key)
        for k in range(0, len(margin), boosting.RANK_EVERY):
            m = margin[k]
            pairs = (m[y == 1][:, None] > m[y == 0]).mean() + 0.5 * (m[y == 1][:, None] == m[y == 0]).mean()
            assert abs(1 - got[k] - pairs) < 0.01
        assert np.isinf(got[1])


def test_stored_models_score_alike(spark, rows):
    fitted = boosting.fit(rows, ["one", "two"], Booster(rounds=15, patience=15, least=10))
    kept = boosting.load(boosting.stored(spark, fitted).repartition(3))
    names = {"one": "p", "two": "q"}
    got, same = (sorted(map(tuple, boosting.score(rows, f, names, ["row_id", "role"]).collect())) for f in (fitted, kept))
    assert got == same and len(got) == 1800
    by = {(r.fold, r.row_id): r for r in rows.collect()}
    for fold, row_id, _, p, _ in got[::97]:
        x = np.array([by[fold, row_id].x], np.float32)
        assert np.isclose(p, np.clip(1 / (1 + np.exp(-sum(t.margins(x)[0] for t in fitted.trees[fold, "one"]))), .001, .999))


def test_sample_is_bounded_and_fixed_rounds(spark, rows):
    made = boosting.fit(rows, ["one"], Booster(most_rows=200, least=5), validate=False, rounds={(1, "one"): 4, (2, "one"): 7})
    assert {k: len(v) for k, v in made.trees.items()} == {(1, "one"): 5, (2, "one"): 8}
    with pytest.raises(ValueError):
        boosting.fit(rows.where("role = 'val'"), ["one"], Booster(rounds=2))
