"""Blend search by descent against a full grid with exact metrics; coverage and matching rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import ID, LABELS, SCORES
from tidemark.operators import blending


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        z = rng.normal() - 1
        y = [int(z + rng.normal() + d > 0.8) for d in (0, .4, .8)]
        y = [y[0], max(y[:2]), max(y)]
        for k, noise in enumerate((.5, 1., 2.)):
            s = [float(np.clip(1 / (1 + np.exp(-(z + rng.normal() * noise - 1 + d))), .001, .999)) for d in (0, .4, .8)]
            rows.append((f"m{k}", i, i % 4 + 1, *s, *y))
    names = ["model", ID, "fold", *SCORES.values(), *LABELS.values()]
    kinds = ["string", "long", "int", *["double"] * 3, *["int"] * 3]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).repartition(5)


MODELS = ["m0", "m1", "m2"]


@pytest.mark.parametrize("penalty", [0.0, 0.5])
def test_descent_reaches_the_grid(spark, long, penalty):
    grid = blending.blend_scores(long, MODELS, blending.simplex_grid(MODELS, 8))
    plain = grid.where("w_m0 = 1").first()
    best = blending.best_blend(grid, plain["worst_fold"] - 1e-9, penalty).first()
    table = blending.sides(long, MODELS)
    found = blending.descend(table, MODELS, floor=plain["worst_fold"] - 1e-3, penalty=penalty)
    exact = blending.blend_scores(long, MODELS, [found["weights"]]).first()
    for name in ("score", "fold_std", "worst_fold"):
        assert found[name] == pytest.approx(exact[name], abs=5e-4)
    assert exact["score"] - penalty * exact["fold_std"] >= best["objective"] - 2e-4
    assert sum(found["weights"].values()) == pytest.approx(1) and min(found["weights"].values()) >= 0


def test_six_systems_stay_one_pass_each(spark, long):
    more = long.unionByName(long.replace({"m0": "m3", "m1": "m4", "m2": "m5"}, subset=["model"]))
    names = [f"m{i}" for i in range(6)]
    found = blending.descend(blending.sides(more, names), names, first=0.25, last=0.1)
    three = blending.descend(blending.sides(long, MODELS), MODELS, first=0.25, last=0.1)
    assert found["score"] >= three["score"] - 1e-9 and found["passes"] < 40


def test_unequal_coverage_is_refused(spark, long):
    with pytest.raises(ValueError):
        blending.sides(long.where(~((F.col("model") == "m1") & (F.col(ID) == 7))), MODELS)
    with pytest.raises(ValueError):
        blending.sides(long.unionByName(long.where(f"model = 'm1' and {ID} = 7")), MODELS)
    one, two = long.where("model = 'm0'"), long.where("model = 'm1'")
    assert blending.stacked_mean(one, two).count() == 1500
    for a, b in ((one.where(f"{ID} > 3"), two), (one, two.where(f"{ID} > 3"))):
        with pytest.raises(ValueError):
            blending.stacked_mean(a, b)
