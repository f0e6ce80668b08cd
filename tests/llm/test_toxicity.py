"""Ordinal regression: gradient, recovery of a known model, held-out accuracy, defined cases."""

import numpy as np
from pyspark.sql import functions as F
from test_quality import auc

from tidemark.llm import toxicity


def test_gradient_and_minimum():
    rng = np.random.default_rng(0)
    n, width = 400, 6
    x = rng.random((n, width)) < 0.4
    rows, at = np.nonzero(x)
    true = np.array([2.0, -1, 0, 1, 0.5, -2])
    grade = (x @ true + rng.logistic(size=n) > np.array([[0.0], [1.5]])).sum(0)
    f = lambda p: toxicity.loss_and_gradient(p, width, grade, rows, at)
    p = rng.normal(size=width + 2) * 0.3
    for i in range(len(p)):
        e = np.zeros(len(p))
        e[i] = 1e-5
        assert abs((f(p + e)[0] - f(p - e)[0]) / 2e-5 - f(p)[1 + i]) < 1e-4
    best = toxicity.minimise(f, np.zeros(width + 2), 200, 1e-9)
    assert np.abs(f(best)[1:]).max() < 1e-2 and np.abs(best[:width] - true).max() < 0.8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.grade(docs, toxicity.grades(labels))
    rows = out.join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and (rows.severity >= rows.score).all()
    seen = rows[rows.held_out & rows.toxic.notna()]
    hit = seen[seen.toxic == 1].predicted.mean()
    false = seen[seen.toxic == 0].predicted.mean()
    print("auc", auc(seen.score.to_numpy(), seen.toxic.to_numpy()), "recall", hit, "false", false)
    assert auc(seen.score.to_numpy(), seen.toxic.to_numpy()) > 0.9 and hit > 0.8 and false < 0.01


def test_defined_cases(spark):
    rows = [(i, "calm words here" if i % 2 else "calm idiot there", "x") for i in range(40)]
    rows += [(100, None, None), (100, None, None), (None, "idiot", None), (101, "", "y"), (102, "idiot " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.grade(docs, toxicity.grades(labels)).collect()
    assert len(out) == 45 and {r.predicted for r in out if r.doc_id in (0, 2, 4, 102, None)} == {1} and {r.predicted for r in out if r.doc_id in (1, 3)} == {0}
    assert len({r.score for r in out if r.doc_id in (100, 101)}) == 1
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0))):
        assert {(r.score, r.severity) for r in toxicity.grade(docs, toxicity.grades(some)).collect()} == {(0.0, 0.0)}
    assert toxicity.grade(docs.limit(0), toxicity.grades(labels)).count() == 0
