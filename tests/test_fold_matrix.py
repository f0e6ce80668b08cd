"""Fold matrices that are joined and written once equal those built for each fold on its own."""

import pytest
from pyspark.sql import functions as F

from tidemark.config import DAY, GATING_KEYS, MINIMAL
from tidemark.functions import fields
from tidemark.operators import encoding, profiles
from tidemark.operators.folds import Fold, in_training
from tidemark.plans import matrix, oof
from tidemark.plans.scores import log_folds
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_codes_by_fold_equal_codes_of_each_fold(spark):
    rows = [(1, "b"), (1, None), (3, "a"), (5, "c"), (9, "d")]
    train = spark.createDataFrame(rows, f"{DAY} int, x string")
    history = spark.createDataFrame([(0, "bb")], f"{DAY} int, x string")
    folds = [Fold(1, 2, 4), Fold(2, 4, 6), Fold(4, 6, 8)]
    for past in (history, None):
        found = {r["value"]: r["code"].asDict() for r in encoding.fold_codes(train, past, ["x"], folds).collect()}
        for f in folds:
            tables = [train.where(in_training(f, F.col(DAY))), *([past] if past else [])]
            own = {r["value"]: r["code"] for r in encoding.category_codes(tables, ["x"]).collect()}
            assert {v: c[f"fold_{f.number}"] for v, c in found.items()} == {v: own.get(v, -1) for v in found}
        assert "d" not in found
        out = encoding.attach_codes(train, encoding.fold_codes(train, past, ["x"], folds), ["x"]).where("x = 'd'").first()
        assert set(out["x_code"].asDict().values()) == {-1}


@pytest.mark.parametrize("name", ["minimal", "everything"])
def test_fold_matrices_equal_direct_builds(spark, sf_dir, name):
    groups = {"minimal": MINIMAL, "everything": oof.EVERYTHING}[name]
    log = TrainingLog(spark, sf_dir)
    folds, frames = log_folds(log), oof._written(spark, sf_dir, name, groups)
    assert [f.number for f in frames] == [f.number for f in folds]
    for fold, frame in list(zip(folds, frames))[1::3]:
        seen = in_training(fold, F.col(DAY))
        own = matrix.transform(log.train.where(F.col(DAY) < fold.end), matrix.fit(log.prior.where(seen), log.train.where(seen), groups), groups)
        own = oof._roles(own, fold)
        assert own.columns == frame.rows.columns and own.dtypes == frame.rows.dtypes and matrix.feature_names(own) == frame.features
        assert matrix.columns_by_block(own) == matrix.columns_by_block(frame.rows)
        assert _rows(own) == _rows(frame.rows)


def test_gate_rows_equal_direct_builds(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    for fold, frame in list(zip(log_folds(log), oof.gate_frames(spark, sf_dir)))[1::3]:
        seen = in_training(fold, F.col(DAY))
        rows = profiles.known_person(oof._roles(log.train, fold), log.prior.where(seen))
        rows = encoding.attach_codes(rows, encoding.category_codes([log.train.where(seen)], GATING_KEYS, missing=fields.MISSING), GATING_KEYS, missing=fields.MISSING)
        rows = rows.withColumns({"topic_flag": fields.has_topic(F.col("topics_list")), "topic_count": fields.topic_count(F.col("topics_list"))})
        assert _rows(rows.select(frame.rows.columns)) == _rows(frame.rows)


def test_rows_of_all_folds_are_joined_once(spark, sf_dir, monkeypatch):
    log, seen = TrainingLog(spark, sf_dir), []
    own = matrix.transform
    monkeypatch.setattr(matrix, "transform", lambda *a: seen.append(1) or own(*a))
    monkeypatch.setattr(workspace, "shared", lambda spark, key, build, partition_by=None: workspace.materialise(build(), "test"))
    monkeypatch.setattr(TrainingLog, "rows", lambda self, held=log.rows(): held)
    assert len(oof.fold_frames(spark, sf_dir)) == 5 and len(seen) == 1


def test_test_rows_by_fold_equal_direct_builds(spark, sf_dir):
    log = TrainingLog(spark, sf_dir)
    found = oof.test_matrices(log)
    files = {tuple(x.inputFiles()) for x in found.values()}
    assert len(files) == 1  # joined once for all folds
    for f in log_folds(log):
        seen = in_training(f, F.col(DAY))
        want = matrix.transform(log.test, matrix.fit(log.prior.where(seen), log.train.where(seen), MINIMAL), MINIMAL)
        assert found[f.number].columns == want.columns and _rows(found[f.number]) == _rows(want)
