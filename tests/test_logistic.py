"""Logistic models of many column sets and folds: equal to Spark's, at a few passes over the rows."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tidemark.operators import logistic, models


def _rows(spark, n=900):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(2000, 3, n), rng.exponential(1, n), rng.integers(0, 2, n)
    y = rng.random(n) < 1 / (1 + np.exp(3 - (a - 2000) / 2 - b + c))
    rows = [(i % 3 + 1, float(a[i]), float(b[i]), int(c[i]), 7.0, float(a[i]) * 2, int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "fold int, a double, b double, c int, same double, twice double, y int").repartition(5).cache()


def test_fits_equal_spark(spark):
    """The minimum of Spark's loss, for constant, repeated and integer columns, by fold left out."""
    rows = _rows(spark)
    sets = {"all": ["a", "b", "c", "same", "twice"], "few": ["b", "c"], "none": ["same"]}
    got = logistic.fit(rows, sets, "y", 1 / 900, 1000)
    assert set(got) == {(s, f) for s in sets for f in (1, 2, 3)}
    for (name, fold), (found, intercept) in got.items():
        train = models.vectors(rows.where(F.col("fold") != fold), sets[name]).select("features", "y")
        want = LogisticRegression(labelCol="y", maxIter=1000, tol=1e-12, regParam=1 / 900).fit(train)
        assert np.allclose([found[c] for c in sets[name]], want.coefficients.toArray(), atol=2e-5)
        # Offsets of columns far from 0 take up the rounding of their coefficients.
        assert abs(intercept - want.intercept) < 0.05
        p = models.score_with(want, models.vectors(rows.where(F.col("fold") == fold), sets[name]), "p")
        mine = logistic.score(rows.where(F.col("fold") == fold), {(name, fold): got[name, fold]}, "y", "columns")
        assert np.allclose(sorted(r["p"] for r in mine.collect()), sorted(r["p"] for r in p.collect()), atol=1e-5)
    assert set(r["columns"] for r in logistic.score(rows, got, "y", "columns").select("columns").distinct().collect()) == set(sets)


def test_one_class(spark):
    rows = _rows(spark).withColumn("y", F.lit(0))
    got = logistic.fit(rows, {"all": ["a", "b"]}, "y", 0.01, 100)
    assert got["all", 1] == ({"a": 0.0, "b": 0.0}, -np.inf)
    assert {r["p"] for r in logistic.score(rows, got, "y", "columns").collect()} == {0.001}


def test_passes_do_not_grow_with_models(spark, monkeypatch):
    """More sets share the passes over the rows: no model has jobs of its own."""
    rows, passes = _rows(spark), []
    own = logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda *a: passes.append(1) or own(*a))
    logistic.fit(rows, {"all": ["a", "b", "c"]}, "y", 1 / 900, 1000)
    one = len(passes)
    logistic.fit(rows, {f"set{i}": ["a", "b", "c"] for i in range(20)}, "y", 1 / 900, 1000)
    assert len(passes) - one == one < 40


def test_category_ablation_runs_few_jobs(spark, sf_dir):
    from tidemark.plans import search
    spark.sparkContext.setJobGroup("ablation", "category ablation")
    try:
        found = {r["columns"]: r for r in search.category_ablation(spark, sf_dir).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ablation")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found["all"]["impact"] == 0 and len(found) > 10 and len(jobs) < 600


def test_nets_of_all_folds_equal_spark(spark):
    """The minimum of Spark's loss with both penalties, on scaled columns and on columns as they are, by fold and label."""
    rows = _rows(spark).withColumn("two", (F.col("b") + F.col("c") > 1).cast("int") * F.col("y")).withColumn("zero", F.lit(0))
    rows = rows.withColumn("a", F.col("a") - 2000).withColumn("twice", F.col("twice") / 2 - 2000)
    columns, frames = ["a", "b", "c", "same", "twice"], [(f, rows.where(F.col("fold") != f).drop("fold")) for f in (1, 2, 3)]
    for share, scaled, penalty in ((0.3, False, 0.02), (0.0, True, 0.002), (1.0, True, 0.01)):
        got = logistic.fit_frames(frames, columns, ["y", "two", "zero"], dict.fromkeys((1, 2, 3), penalty), share, scaled)
        assert set(got) == {(f, y) for f in (1, 2, 3) for y in ("y", "two", "zero")}
        assert all(got[f, "zero"][1] == -np.inf for f in (1, 2, 3))
        for f, train in frames[1:2]:
            for y in ("y", "two"):
                ready = models.vectors(train, columns)
                want = LogisticRegression(labelCol=y, maxIter=5000, tol=1e-14, regParam=penalty, elasticNetParam=share, standardization=scaled).fit(ready)
                both = models.score_with(want, ready, "p").withColumn("mine", logistic.probability(columns, *got[f, y])).select("p", "mine").collect()
                assert len(both) == 600 and np.allclose([r["mine"] for r in both], [r["p"] for r in both], atol=2e-5)


def test_a_harness_run_fits_linear_models_together(spark, monkeypatch):
    """No model of its own per fold and label, each of which would hold its fold's rows; the scores are those models' scores."""
    from tidemark.config import LABELS, SCORES
    rows = _rows(spark).withColumn("row_id", F.monotonically_increasing_id()).drop("fold")
    rows = rows.withColumns({y: F.col("y") for y in LABELS.values()}).withColumn("role", F.when(F.col("row_id") % 3 == 0, "val").otherwise("train")).cache()
    frames = [models.FoldFrame(f, rows, ["a", "b", "c"]) for f in (1, 2)]
    learner = models.linear("elastic", 0.5, 0.3, 600, standardised=False)
    want = learner.make("y").setTol(1e-12).setMaxIter(1000).fit(models.vectors(frames[0].train(), ["a", "b", "c"]))
    want = {r["row_id"]: r["p"] for r in models.score_with(want, models.vectors(frames[0].val(), ["a", "b", "c"]), "p").collect()}
    monkeypatch.setattr(models, "fit_targets", None)
    out = models.out_of_fold(frames, learner).collect()
    assert len(out) == 2 * len(want) and all(abs(r[p] - want[r["row_id"]]) < 1e-5 for r in out for p in SCORES.values())
