"""Model runs: coverage, range, order and better-than-chance invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import ID, LABELS, MINIMAL, SCORES, VETTED
from tidemark.operators import folds, models
from tidemark.plans import matrix, oof, search
from tidemark.plans.scores import log_folds
from tidemark.sources.training_log import TrainingLog


@pytest.fixture(scope="module")
def covered(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    fold = folds.validation_fold(log_folds(log), F.col("day"))
    return {(r[ID], r["fold"]) for r in log.train.select(ID, fold.alias("fold"))
            .where(F.col("fold").isNotNull()).collect()}


def check(df, covered):
    pdf = df.toPandas()
    assert set(zip(pdf[ID], pdf["fold"])) == covered and len(pdf) == len(covered)
    for p in SCORES.values():
        assert pdf[p].between(.001, .999).all()
    return pdf


def test_boosted_and_calibrated(spark, sf_dir, covered):
    base = oof.saved(spark, sf_dir, "test-gbt", lambda: oof.gbt(spark, sf_dir, **models.PROBE_HEAD))
    check(base, covered)
    long = oof.calibrated(base, ["none", "isotonic"]).toPandas()
    for h, y in LABELS.items():
        loss = {m: -(g[y] * np.log(g[SCORES[h]]) + (1 - g[y]) * np.log(1 - g[SCORES[h]])).mean()
                for m, g in long.groupby("model")}
        rate = long[y].mean()
        flat = -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
        # In-sample isotonic scores are never worse than the raw ones or the prevalence.
        assert loss["isotonic"] <= loss["none"] + 1e-6 and loss["isotonic"] <= flat + 1e-6


def test_same_seed_same_scores(spark, sf_dir):
    frames = oof.fold_frames(spark, sf_dir)[:1]
    one, two = (models.out_of_fold(frames, models.boosted(**models.PROBE_HEAD)).orderBy(ID).toPandas()
                for _ in range(2))
    assert one.equals(two)


def test_hazard_scores_are_ordered(spark, sf_dir, covered):
    pdf = check(oof.hazard(spark, sf_dir), covered)
    assert ((pdf.p07 <= pdf.p90 + 1e-12) & (pdf.p90 <= pdf.p120 + 1e-12)).all()


def test_interval_network_scores_are_ordered(spark, sf_dir, covered):
    pdf = check(oof.interval_network(spark, sf_dir, hidden=(8,)), covered)
    assert ((pdf.p07 <= pdf.p90) & (pdf.p90 <= pdf.p120)).all()


def test_cohort_calibration_keeps_all_rows(spark, sf_dir, covered):
    base = oof.saved(spark, sf_dir, "test-gbt", lambda: oof.gbt(spark, sf_dir, **models.PROBE_HEAD))
    out = oof.cohort_calibrated(base.withColumn("cohort", (F.col(ID) % 4).cast("int")))
    pdf = check(out, covered)
    assert ((pdf.p07 <= pdf.p90) & (pdf.p90 <= pdf.p120)).all()
    assert set(pdf.method) <= set(oof.COHORT_METHODS)


def test_wide_matrix_subset_equals_direct_build(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    wide = matrix.transform(log.train, matrix.fit(log.prior, log.train, oof.EVERYTHING), oof.EVERYTHING)
    for groups in (MINIMAL, VETTED, oof.GROUP_SETS["warm"], oof.GROUP_SETS["cold"],
                   MINIMAL.but(confidence=True), MINIMAL.but(quality=True)):
        own = matrix.transform(log.train.limit(1), matrix.fit(log.prior, log.train, groups), groups)
        assert set(matrix.block_columns(wide, groups)) == set(
            matrix.feature_names(own))


def test_search_records_stopped_trials(spark, sf_dir):
    rows = search.param_search(spark, sf_dir, 6, {"7d": "07"}, block=20).collect()
    assert len(rows) == 6 and {r.study for r in rows} == {"7d"}
    assert all(r.rounds >= 20 and r.objective in (0.0, r.score) for r in rows)
    # After a block at least every second trial that is still going has stopped.
    assert sum(r.rounds <= 20 for r in rows) >= 3 and all(r.stopped == (r.rounds < eval(r.params)["rounds"]) for r in rows)


def test_refits_show_a_changed_seed(spark, sf_dir):
    found = {r.model: r for r in search.refits(spark, sf_dir, {"same": [1, 1], "other": [1, 2]}, rounds=20).collect()}
    assert found["same"].spread == 0 and found["same"].reproducible == 1
    assert found["other"].spread > 0 and found["other"].reproducible == 0


def test_stages_and_fold_averaged_scores(spark, sf_dir):
    stages = oof.fold_models(spark, sf_dir).groupBy("fold", "label").agg(F.max("grown").alias("n"), F.max("stage").alias("best")).collect()
    assert len(stages) == 3 * len(oof.fold_frames(spark, sf_dir))
    assert all(r.n == 1000 or r.n - r.best >= 50 for r in stages)
    scores = oof.fold_averaged(spark, sf_dir).toPandas()
    assert len(scores) == TrainingLog(spark, sf_dir).test.count() == scores[ID].nunique()
    assert all(scores[p].between(.001, .999).all() for p in SCORES.values())


def test_one_hot_takes_missing_and_unseen_values(spark, sf_dir, monkeypatch):
    log = TrainingLog(spark, sf_dir)
    days = sorted(r[0] for r in log.train.select("training_day").distinct().collect() if r[0])
    cutoff = str(days[len(days) // 2])
    late = F.col("training_day") >= F.lit(cutoff).cast("date")
    odd = log.train.withColumn("ward", F.when(late, F.concat(F.lit("new "), "ward")).otherwise(F.col("ward")))
    odd = odd.withColumn("county", F.when(F.col(ID) % 3 == 0, F.lit(None)).otherwise(F.col("county")))
    monkeypatch.setattr(TrainingLog, "train", property(lambda self: odd))
    out = oof.one_hot_baseline(spark, sf_dir, cutoff).toPandas()
    assert len(out) == odd.where(late | F.col("training_day").isNull()).count()
    assert all(out[p].between(.001, .999).all() for p in SCORES.values())


def test_unknown_study_is_refused(spark, sf_dir):
    with pytest.raises(ValueError):
        search.param_search(spark, sf_dir, 1, {"7d_ll": "07"})
