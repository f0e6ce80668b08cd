"""Label encodings by day in a fit, and balanced boosting."""

import numpy as np
from pyspark.sql import functions as F
from tidemark.config import DAY, ENCODED_KEYS, ID
from tidemark.operators import boosting, models, profiles
from tidemark.operators.folds import fold_roles
from tidemark.plans import oof
from tidemark.plans.scores import log_folds
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog

LABEL_NAMES = "adopted_within_07_days int, adopted_within_90_days int, adopted_within_120_days int"


def test_earlier_counts_leave_out_the_own_day_and_missing_keys(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1, 1), (1, "a", 0, 1, 1), (2, "a", 1, 1, 1), (2, None, 0, 0, 0), (3, "a", 0, 0, 1), (3, "b", 1, 1, 1)],
                                 f"day int, county string, {LABEL_NAMES}")
    found = {(r.key_value, r.day): r for r in profiles.earlier_counts(rows, ["county"]).collect()}
    assert set(found) == {("a", 2), ("a", 3)}
    assert (found["a", 2].n, found["a", 2].s07) == (2, 1) and (found["a", 3].n, found["a", 3].s07) == (3, 2)
    assert found["a", 3].g07 == 0.5 and profiles.earlier_counts(rows.limit(0), ["county"]).count() == 0


def test_encoded_frames_keep_all_rows(spark, sf_dir):
    plain = {f.number: f.rows.count() for f in oof.fold_frames(spark, sf_dir)}
    for by_day in (False, True):
        frames = oof.encoded_frames(spark, sf_dir, by_day)
        assert {f.number: f.rows.count() for f in frames} == plain
        assert all(len([c for c in f.features if c.startswith("te_")]) == 10 * len(ENCODED_KEYS) for f in frames)


def test_balanced_trees_start_from_equal_weights():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 3)), (np.arange(400) % 10 == 0).astype(float)
    plain = boosting.grow_block(x, y, np.ones(400), [], boosting.Booster(), 1, 1)[0]
    even = boosting.grow_block(x, y, np.ones(400), [], boosting.Booster(balanced=True), 1, 1)[0]
    assert np.isclose(boosting.sigmoid(plain.value)[0], 0.1) and np.isclose(boosting.sigmoid(even.value)[0], 0.5)


def test_encodings_by_key_equal_those_by_row(spark, sf_dir):
    """Frames read from rows that met their keys once, beside encodings joined to every fold's rows by id."""
    log = TrainingLog(spark, sf_dir)
    made, keys = log_folds(log), [DAY, *ENCODED_KEYS]
    encodings = workspace.materialise(profiles.target_encoding(profiles.key_counts(log.train, ENCODED_KEYS, made)), "encodings")
    daily = workspace.materialise(profiles.daily_encoding(log.train, ENCODED_KEYS), "encodings")
    by_fold = profiles.attach_encodings(fold_roles(log.train.select(ID, *keys), made), encodings, ENCODED_KEYS).drop("role", *keys)
    by_day = profiles.attach_encodings(log.train.select(ID, *keys), daily, ENCODED_KEYS).drop(*keys)
    plain = {f.number: f for f in oof.fold_frames(spark, sf_dir)}
    for day in (False, True):
        for f in (oof.encoded_frames(spark, sf_dir, day)[i] for i in (0, -1)):
            own, before = by_fold.where(F.col("fold") == f.number).drop("fold"), plain[f.number]
            want = before.train().join(by_day, ID).unionByName(before.val().join(own, ID)) if day else before.rows.join(own, ID)
            names = [ID, "role", *f.features]
            assert f.features == [*before.features, *[c for c in want.columns if c.startswith("te_")]]
            assert sorted(map(tuple, f.rows.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_known_sizes_are_not_counted_again(spark, sf_dir):
    for by_day in (False, True):
        frames = oof.encoded_frames(spark, sf_dir, by_day)
        assert [f.size for f in frames] == [f.train().count() for f in frames]
    f, s = frames[-1], models.boosted("encoded", most_rows=50)
    few = models.boosting_rows([f], s, sample=True).where("role = 'train'").count()
    assert few == models.boosting_rows([models.FoldFrame(f.number, f.rows, f.features)], s, sample=True).where("role = 'train'").count() < f.size
