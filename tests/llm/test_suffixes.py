"""Repeated strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffixes


def brute(rows, span):
    seen = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            seen[b[i:i + span]] = seen.get(b[i:i + span], 0) + 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_match_lengths():
    rnd = random.Random(1)
    for _ in range(60):
        bodies = [bytes(rnd.choices(b"ab", k=rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 7))]
        bodies += [bodies[0]] * rnd.randrange(2)
        best, first = suffixes.match_lengths(bodies)
        places = [(k, i) for k, b in enumerate(bodies) for i in range(len(b))]
        for k, i in places:
            want = 0
            for m, j in places:
                if (k, i) != (m, j):
                    n = 0
                    while i + n < len(bodies[k]) and j + n < len(bodies[m]) and bodies[k][i + n] == bodies[m][j + n]:
                        n += 1
                    want = max(want, n)
            assert best[first[k] + i] == want


def test_names_depend_on_the_window_alone():
    rnd = random.Random(2)
    for span, gram in ((20, 5), (9, 9), (13, 1), (40, 32)):
        data = np.frombuffer(bytes(rnd.choices(b"abc", k=300)), np.uint8)
        names = lambda x: suffixes.lowest(suffixes.grams(x, gram), span - gram + 1)
        got = names(data)
        assert len(got) == 300 - span + 1
        assert all(got[i] == names(data[i:i + span].copy())[0] for i in range(0, len(got), 7))


@pytest.mark.parametrize(("span", "gram", "shard"), [(20, 5, 1 << 20), (20, 5, 300), (20, 20, 1 << 20), (12, 4, 0)])
def test_against_all_windows(spark, span, gram, shard):
    rnd = random.Random(span + gram)
    text = lambda n, pool="abé ": "".join(rnd.choices(pool, k=n))
    base = [text(rnd.randrange(10, 90)) for _ in range(12)]
    rows = []
    for d in range(50):
        parts = [text(rnd.randrange(40))]
        for _ in range(rnd.randrange(3)):
            x = list(rnd.choice(base))
            if rnd.random() < 0.6:
                x[rnd.randrange(len(x))] = rnd.choice("xyz")
            parts += ["".join(x), text(rnd.randrange(30))]
        rows.append((d, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, "q" * span), (105, "r" * (span + 1)), (None, rows[3][1]),
             (None, None), (7, rows[7][1]), (106, text(3000))]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, name int, start string").repartition(4)
    got = suffixes.remove(docs, span, gram=gram, shard_bytes=shard, with_bytes=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows, span)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty_and_unique(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert {tuple(r)[:4] for r in suffixes.remove(docs).collect()} == {(1, 5, 0, 0), (2, 0, 0, 0)}
    assert suffixes.remove(docs.limit(0)).count() == 0
