"""Exact deduplication against a dictionary of normalised texts."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import catalog, exact


def lower(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    out = []
    for body, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        left = 1
        for d in ids:
            stays = d == keep and left > 0
            left -= stays
            out.append((d, keep, len(ids), stays, hashlib.sha256(body).hexdigest()))
    return Counter(out)


def naive(body, moduli):
    out = []
    for base, p in zip(exact.BASES, moduli):
        h = 0
        for x in body:
            h = (h * base + x + 1) % p
        out.append(h)
    return (*out, len(body))


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
@pytest.mark.parametrize("moduli", [exact.MODULI, (7, 5)])
def test_fingerprints_do_not_depend_on_cuts(chunk, moduli):
    rnd = random.Random(chunk)
    bodies = [b"", b"a", bytes(range(256)), *(rnd.randbytes(rnd.randrange(300)) for _ in range(30)), b""]
    got = exact.Chunks(bodies, chunk, moduli).prints(len(bodies), moduli)
    assert got == [naive(bytes(exact.K.LOWER[np.frombuffer(b, np.uint8)]), moduli) for b in bodies]
    left, right = bodies[5], bodies[2]
    assert exact.combine(naive(left, moduli), naive(right, moduli), moduli) == naive(left + right, moduli)


def fixture():
    rnd = random.Random(9)
    base = ["".join(rnd.choices("abCD é\n", k=rnd.randrange(1, 60))) for _ in range(40)]
    rows = [(d, rnd.choice(base).swapcase() if rnd.random() < 0.3 else rnd.choice(base)) for d in range(300)]
    rows += [(1000 + d, "hot Text " * 30) for d in range(200)]
    rows += [(400, None), (401, ""), (None, "hot text " * 30), (None, "only null"), (None, "ONLY null"), (402, "É"), (403, "é"),
             (7, rows[7][1]), (1199, "HOT text " * 30), (1199, "hot text " * 30), (404, "long " * 50_000), (405, "lonG " * 50_000), (406, "long " * 49_999 + "lonk ")]
    return rows


@pytest.mark.parametrize(("chunk", "moduli"), [(exact.CHUNK, exact.MODULI), (16, exact.MODULI), (exact.CHUNK, (7, 5)), (50, (2, 3))])
def test_classes(spark, chunk, moduli):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 1, "y", 3) for d, t in rows], "doc_id long, text string, copies int, keep_id string, print int").repartition(5)
    got = Counter(map(tuple, exact.judge(docs, chunk=chunk, moduli=moduli).collect()))
    assert got == brute(rows)
    found = exact.collisions(docs, chunk, moduli).count()
    assert (found > 0) == (moduli != exact.MODULI)


def test_keep_last(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, d, t, "x") for i, (d, t) in enumerate(rows)], "copies int, doc_id long, text string, print string").repartition(3)
    kept = exact.keep_last(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    want = Counter(k[0] for k, n in brute(rows).items() for _ in range(n) if k[3])
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == want
    assert len({lower(r.text) for r in got}) == len(got) and all(rows[r.copies] == (r.doc_id, r.text) for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.judge(docs).count() == 0 and exact.keep_last(docs).count() == 0


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(exact.ORACLE).fetchall()
    got = catalog.QUERIES["op12_exact"](spark, sf_dir)
    assert got.columns == [x[0] for x in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want)
