"""Periodic runs against a search over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import catalog, periods


def brute_runs(words, least, copies):
    n, out = len(words), set()
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, copies * q):
                stretch = words[s:s + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, least=24, copies=3, plant=True):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words, least, copies)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    start, length, q = best or (None, None, None)
    return (doc_id, len(runs), start, length, q, 1000 * length // q if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def odd_text(rnd):
    out = []
    for _ in range(rnd.randrange(5)):
        kind = rnd.randrange(5)
        unit = rnd.choices("a b c dd é".split() if kind < 3 else ["x", "y"], k=rnd.randrange(1, 14))
        out += unit * rnd.randrange(1, 9) + unit[:rnd.randrange(len(unit))]
        if kind == 4:
            out += out[-rnd.randrange(1, 40):] * 3
    return rnd.choice([" ", "\n", "\t \r"]).join(out)


@pytest.mark.parametrize(("least", "copies"), [(24, 3), (4, 2), (1, 2), (9, 3), (12, 5), (7, 4)])
def test_runs_of_random_words(least, copies):
    rnd = random.Random(least * 10 + copies)
    for _ in range(120):
        texts = [odd_text(rnd) for _ in range(rnd.randrange(1, 5))]
        runs, kept = periods.collapse_block([t.encode() for t in texts], [1] * len(texts), least, copies, None)
        for t, got, left in zip(texts, runs, kept):
            want = brute_runs(t.split(), least, copies)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            gone = {i for s, length, q in want for i in range(s + q, s + length)}
            assert left == " ".join(w for i, w in enumerate(t.split()) if i not in gone)


def test_ordered_positions():
    rnd = random.Random(4)
    places = rnd.sample(range(10_000), 3000)
    held = periods.Positions(places[0])
    for x in places[1:]:
        held.add(x)
    ordered = sorted(places)
    assert list(held) == ordered and held.size == 3000
    for k in range(0, 3000, 37):
        assert held.around(ordered[k]) == (ordered[k - 1] if k else None, ordered[k + 1] if k < 2999 else None)


def test_suspects_miss_no_repeat():
    rnd = random.Random(5)
    for size in (1, 5, 16, 21):
        codes = np.array(rnd.choices(range(1, 4), k=600), np.uint64)
        count = np.array([100, 0, 250, 20, 230])
        first = np.cumsum(count) - count
        doc = np.repeat(np.arange(5), count)
        mixed = codes * np.uint64(0x9E3779B97F4A7C15)
        got = set(periods._suspects(mixed ^ (mixed >> np.uint64(29)), doc, first, count, size).tolist())
        for d in range(5):
            row = codes[first[d]:first[d] + count[d]].tolist()
            strings = [tuple(row[i:i + size]) for i in range(len(row) - size + 1)]
            assert (d in got) == (len(set(strings)) < len(strings))


def test_query_rows(spark):
    rnd = random.Random(6)
    rows = [(d, odd_text(rnd)) for d in range(300)]
    rows += [(None, "a b " * 30), (None, None), (300, None), (301, ""), (302, " \n\t "), (7, rows[7][1]), (7, rows[7][1]), (8, "other"),
             (303, "z " * 5000), (304, " ".join(rnd.choices("abcdefgh", k=20_000))), (305, "a b\x0bc " * 30), (306, "\x00 " * 40)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2.0) for d, t in rows], "doc_id long, text string, runs int, best string, period double")
    got = periods.digest(docs.repartition(5), rewrite=periods.planted).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(d, t) for d, t in rows), key=repr)
    assert periods.digest(docs.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periods.collapse(docs.where("doc_id in (302, 303)")).collect()}
    assert plain[303].text == "z" and plain[303].runs[0].length == 5000 and plain[302].runs == []


def test_long_repeats_stay_cheap():
    """A word a hundred thousand times, and a long period: no step may be quadratic."""
    unit = " ".join(f"w{i}" for i in range(30_000))
    runs, kept = periods.collapse_block([b"z " * 100_000, (unit + " ").encode() * 4], [1, 1], 24, 3, None)
    assert runs == [[{"start": 0, "length": 100_000, "period": 1}], [{"start": 0, "length": 120_000, "period": 30_000}]]
    assert kept == ["z", unit]


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.QUERIES["op11_periods"](spark, sf_dir).collect()
    some = {r.doc_id for r in docs if len(r.text or "") < 6000}
    assert len(got) == len(docs) and len(some) > 100
    assert sorted(tuple(r) for r in got if r.doc_id in some) == sorted(brute(r.doc_id, r.text) for r in docs if r.doc_id in some)
