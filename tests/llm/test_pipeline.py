"""The pipeline's stages, each against a plain version on what the stage before it left."""

import hashlib
from collections import Counter

import corpus_pipeline
import test_decontam
import test_lines_characters
import test_simhash
from test_packing import check

from tidemark.llm import lines, quality
from tidemark.llm.tables import write

SF = "/root/testdata/sf0.001"


def quick(a, b, limit=2):
    """Edit distance up to ``limit``, more beyond it, by rows that stop early; lines that share few characters first."""
    if sum((Counter(a) - Counter(b)).values()) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        lo, hi = max(1, i - limit), min(len(b), i + limit)
        if lo > 1:
            last, row[lo - 1] = row[lo - 1], limit + 1
        for j in range(lo, hi + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != b[j - 1]))
        if hi < len(b):
            row[hi + 1] = limit + 1
        if min(row[lo - 1:hi + 1]) > limit:
            return limit + 1
    return row[-1]


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (out, write(stage(spark, out, SF), "test"))
        out = seen[name][1]
        assert name == "packing" or out.columns == docs.columns
    before, after = seen["quality"]
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == good and after.count() == len(good) > 100
    before, after = seen["line_dedup"]
    monkeypatch.setattr(test_lines_characters, "distance", quick)
    settings = {"max_edits": 2, "min_bytes": lines.MIN_CHARACTERS, "characters": True, "exact": 1}
    cut = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in lines.digest(before, **settings).collect()), key=repr)
    assert cut == sorted(test_lines_characters.brute(rows(before), 2, lines.MIN_CHARACTERS, 1), key=repr)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    texts = dict(rows(after))
    assert sorted((d, hashlib.sha256(texts[d].encode()).hexdigest()) for d, *_ in cut) == sorted((c[0], c[3]) for c in cut)
    before, after = seen["near_dedup"]
    heads = {d for d, _, c in test_simhash.brute(rows(before)) if d == c}
    assert sorted(d for d, _ in rows(after)) == sorted(heads)
    before, after = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = sorted(r[0] for r in test_decontam.brute(rows(before), bench) if not r[-1])
    assert sorted(d for d, _ in rows(after)) == clean and len(clean) < before.count()
    before, after = seen["packing"]
    check(spark, rows(before), 1024)
    whole = corpus_pipeline.run(spark, SF)
    total = lambda df: df.groupBy().sum("length").first()[0]
    assert whole.columns == after.columns and (whole.count() > 0, total(whole)) == (True, total(after))


def test_empty_and_odd_rows(spark):
    odd = [(1, None, "en", None), (2, "", None, 0), (2, "", None, 0), (None, "some words. of a text", "fr", 3)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = write(stage(spark, df, SF), "test")
        assert df.columns[0] == "doc_id"
