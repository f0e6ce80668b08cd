"""Quality classifier: held-out accuracy, isotonic pooling, defined cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    seen = rows[rows.held_out & rows.quality.notna()]
    assert auc(seen.score.to_numpy(), seen.quality.to_numpy()) > 0.95
    flipped = quality.classify(docs, labels.withColumn(
        "quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert (flipped.toPandas().set_index("doc_id").score.sort_index() == rows.set_index("doc_id").score.sort_index()).all()
    kept = quality.keep_good(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows.doc_id[rows.predicted == 1]) and kept.schema == docs.schema


def test_defined_cases(spark):
    rows = [(1, None, 5.0), (1, None, 5.0), (None, "", 1.0), (2, "word " * 30000, 0.0), (3, "A!! B!!\n\n\x00é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y double")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id == 1}) == 1
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_isotonic_pools_violators():
    knots, values = quality._isotonic(np.array([[0.1, 2, 0], [0.2, 2, 2], [0.4, 2, 0], [0.9, 1, 1]]))
    assert np.allclose(knots, [0.1, 0.3, 0.9]) and np.allclose(values, [0, 0.5, 1])
