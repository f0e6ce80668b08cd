"""Packing as the query runs it, against the tokenizers library's call with its default setting."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import catalog, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
RUNS = [" " * 1_000_000, "a" + "\n" * 2_000_000 + "b", " \n\t　" * 250_000, "x " + " " * packing.SAFE_RUN + " y"]
ADDED = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext |>", "plain text"]


def literal(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def ids(enc, text):
    return np.frombuffer(enc.encode(text), enc.kind).tolist()


def test_long_runs_and_added_tokens():
    enc = packing.Encoder(PATH, added=True)
    for text in RUNS + ADDED:
        assert ids(enc, text) == literal(text)
    assert 50256 in ids(enc, ADDED[1]) and 50256 not in ids(packing.Encoder(PATH), ADDED[1])
    assert len(ids(packing.Encoder(PATH), RUNS[0])) == 1_000_000


def test_longest_run_of_the_quick_encoder(monkeypatch):
    enc = packing.Encoder(PATH, added=True)
    monkeypatch.setattr(enc, "own", None)
    for c in " \n　\x85":
        for text in (c * packing.SAFE_RUN, f"a{c * packing.SAFE_RUN}b", f"{c * packing.SAFE_RUN}.{c * packing.SAFE_RUN}"):
            assert ids(enc, text) == literal(text)


@pytest.mark.parametrize("run", [catalog.op4_packing, lambda s, d: corpus_pipeline.pack(s, s.read.parquet(f"{d}/documents.parquet"), d)])
def test_query_is_the_literal_call(spark, tmp_path, run):
    texts = [*ADDED, RUNS[0], RUNS[1]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.doc_tokens for r in run(spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().collect()}
    assert got == {i: len(literal(t)) + 1 for i, t in enumerate(texts)}
