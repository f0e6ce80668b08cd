"""Packing: exact ids, gapless windows, round trip."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

TEXTS = [None, "", " ", "a", "a b", "a  b", " a\nb ", "x \n y", "Ção é. don't I'll 12 3,4", "<|endoftext|> x<|endoftext|>", "\n\n\n", "a b　 c",
         "word " * 3000, "é" * 5000, "tab\tand\r\nline", "a b c \x1c d\x85 e", "the the the", "the the the"]


def ids(text, tok):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def tokenizer():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def check(spark, rows, length, forget=None):
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, part string, n int").repartition(3)
    got = sorted((r.asDict() for r in packing.pack(docs, length, with_ids=True).collect()), key=lambda r: (r["sequence_id"], r["offset"]))
    tok, stream, parts = tokenizer(), [], {}
    for r in got:
        assert r["offset"] + r["length"] <= length and r["length"] > 0
        assert r["sequence_id"] * length + r["offset"] == len(stream)
        piece = np.frombuffer(r["ids"], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        stream.extend(piece)
        parts.setdefault((r["doc_id"], r["sequence_id"] * length + r["offset"] - r["start"]), []).append((r["start"], piece, r["doc_tokens"]))
    whole = []
    for (d, _), ps in parts.items():
        ps.sort(key=lambda p: p[0])
        joined = np.concatenate([p for _, p, _ in ps]).tolist()
        assert all(n == len(joined) for _, _, n in ps)
        whole.append((d, joined))
    assert sorted(whole, key=repr) == sorted(((d, ids(t, tok)) for d, t in rows), key=repr)


def test_round_trip(spark):
    check(spark, [*enumerate(TEXTS), (None, "no id"), (3, "same id")], 7)
    check(spark, list(enumerate(TEXTS)), 1024)


def test_both_encoders_agree(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    quick, tok = packing.Encoder(path), tokenizer()
    assert quick.size == 50256 and packing.PATTERN == public_tokenizers.PATTERN
    monkeypatch.setattr(packing, "ranks", lambda _: None)
    slow = packing.Encoder(path)
    texts = [t or "" for t in TEXTS] + [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}." for c in range(0, 0x11000, 7) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert np.frombuffer(quick.encode(t), quick.kind).tolist() == np.frombuffer(slow.encode(t), slow.kind).tolist() == ids(t, tok)[:-1]
    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode("a word")


def test_real_documents_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert packing.pack(docs.limit(0)).count() == 0
