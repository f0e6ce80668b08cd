"""Line deduplication against an all-pairs version."""

import hashlib
import random

import pytest

from tidemark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, x, n):
    x = list(x)
    for _ in range(n):
        k, i = rnd.randrange(3), rnd.randrange(len(x) + 1)
        if k == 0:
            x.insert(i, rnd.choice("abé"))
        elif x:
            i = min(i, len(x) - 1)
            if k == 1:
                del x[i]
            else:
                x[i] = rnd.choice("abé")
    return "".join(x)


def test_banded_distance():
    rnd = random.Random(0)
    for _ in range(4000):
        a = "".join(rnd.choices("ab", k=rnd.randrange(14)))
        b = edited(rnd, a, rnd.randrange(6)) if rnd.random() < 0.8 else "".join(rnd.choices("ab", k=rnd.randrange(14)))
        x, y = a.encode(), b.encode()
        for limit in range(6):
            assert lines.within(x, y, limit) == (distance(x, y) <= limit), (x, y, limit)


def brute(rows, limit, least):
    units = [(d is None, d, i, x.encode()) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(x.encode()) >= least]
    distinct = sorted({u[3] for u in units})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if abs(len(x) - len(y)) <= limit and distance(x, y) <= limit:
                root[find(x)] = find(y)
    head = {}
    for n, d, i, x in units:
        c = find(x)
        head[c] = min(head.get(c, (n, d or 0, i)), (n, d or 0, i))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        parts = t.split("\n")
        kept = [x for i, x in enumerate(parts) if len(x.encode()) < least or head[find(x.encode())] == (d is None, d or 0, i)]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    base = ["".join(rnd.choices("abcdé ", k=rnd.randrange(6, 40))) for _ in range(25)] + ["a" * 20, "abab" * 6]
    out = []
    for d in range(60):
        out.append((d, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randrange(6)))))
    # one line in very many versions that differ in a byte or two
    fam = [edited(rnd, "common line of many copies", rnd.choice([1, 1, 2])) for _ in range(150)]
    out += [(100 + i, x) for i, x in enumerate(fam)]
    return out + [(None, base[0] + "\n" + base[1]), (None, base[0]), (5000, None), (5001, ""), (5002, "\n\n" + "x" * 40000 + "\n"),
                  (5003, "x" * 40001), (5004, base[2]), (5004, base[2])]


@pytest.mark.parametrize(("limit", "bucket"), [(1, 64), (1, 3), (2, 64), (0, 64)])
def test_against_all_pairs(spark, rows, limit, bucket):
    docs = spark.createDataFrame([(d, t, "s", 3) for d, t in rows], "doc_id long, text string, root string, line int").repartition(5)
    got = lines.digest(docs, max_edits=limit, min_bytes=8, bucket=bucket).collect()
    short = [r for r in rows if r[1] is None or len(r[1]) < 30000]
    assert sorted((tuple(r) for r in got if r.doc_id not in (5002, 5003)), key=repr) == brute([r for r in short], limit, 8)
    far = {r.doc_id: r.n_removed for r in got}
    assert (far[5002], far[5003]) == (0, 1 if limit else 0)
    out = lines.deduplicate(docs, max_edits=limit, min_bytes=8, bucket=bucket)
    assert out.schema == docs.schema and out.count() == docs.count()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.digest(docs).count() == 0
    assert [tuple(r)[1:3] for r in lines.digest(spark.createDataFrame([(1, None), (None, None)], docs.schema)).collect()] == [(0, 0)] * 2
