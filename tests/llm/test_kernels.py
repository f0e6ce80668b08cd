"""Vectorised hashes and word spans against plain versions."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from tidemark.llm import kernels as K


def test_xxh64_of_all_short_lengths_and_some_long():
    rnd = random.Random(0)
    data = np.frombuffer(rnd.randbytes(9000) + bytes(8), np.uint8)
    spans = [(rnd.randrange(4000), n) for n in [*range(200), 1000, 4999]]
    start, size = (np.array(x) for x in zip(*spans))
    for seed in (0, 42):
        got = K.xxh64(data, start, size, seed)
        assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s:s + n].tobytes(), seed) for s, n in spans]


def test_words_do_not_cross_texts():
    texts = [b"", b"A b", b"c", b" \n", b"d  e\tF "]
    w = K.Words(texts, K.SPACES)
    assert [bytes(w.data[s:e]) for s, e in zip(w.start, w.end)] == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert w.count.tolist() == [0, 2, 1, 0, 3] and w.doc.tolist() == [1, 1, 2, 4, 4, 4]
    assert list(K.blocks(pa.array(["x" * 5, "y", "z" * 9, None, ""]), 6)) == [(0, 2, [b"xxxxx", b"y"]), (2, 3, [b"z" * 9]), (3, 5, [b"", b""])]
