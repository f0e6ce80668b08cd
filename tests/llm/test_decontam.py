"""Decontamination against all windows, in Python and in SQL."""

import hashlib
import random
import re

import pytest
from oracle_check import compare, duck

from tidemark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, span=13, share=20):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in bench:
            x = words(text)
            n = min(span, len(x))
            if item is None or not n:
                continue
            have = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in have:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("span", "gram", "vocabulary"), [(13, 8, 3), (13, 8, 40), (4, 2, 3), (13, 3, 3), (1, 1, 5)])
def test_against_all_windows(spark, span, gram, vocabulary):
    rnd = random.Random(span * gram)
    pool = ["The", "a", "É", "é", "x9", "of", "日本"] [:vocabulary] + [f"w{i}" for i in range(max(0, vocabulary - 7))]
    text = lambda n: rnd.choice([" ", ", ", "\n", "--"]).join(rnd.choices(pool, k=n))
    bench = [(i, text(rnd.choice([1, 2, 5, 8, 9, 12, 13, 14, 30]))) for i in range(0 if vocabulary == 5 else 6, 16)]
    bench += [(20, None), (21, " .. "), (None, text(14)), (bench[0][0], text(20))]
    docs = []
    for d in range(60):
        parts = [text(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            x = words(rnd.choice(bench)[1])
            parts += [" ".join(x[rnd.randrange(3):]).upper(), text(rnd.randrange(40))]
        docs.append((d, "!".join(parts)))
    docs += [(900, None), (901, ""), (902, "..."), (None, docs[5][1]), (None, None), (7, docs[7][1]), (903, text(6000))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, words string")
    bf = spark.createDataFrame([(d, t, "y") for d, t in bench], "item_id long, text string, length string")
    got = decontam.contamination(df, bf, span=span, gram=gram).drop("text_key")
    want = brute(docs, bench, span)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    kept = decontam.keep_clean(df, bf, span=span, gram=gram)
    assert kept.columns == df.columns and kept.count() == sum(not r[-1] for r in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r)[2:5] for r in decontam.contamination(docs, bench).collect()} == {(2, 0, 0), (0, 0, 0)}
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = decontam.contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).drop("text_key")
    cur = duck(sf).execute(decontam.ORACLE)
    assert compare([tuple(r) for r in got.collect()], got.columns, cur.fetchall(), [c[0] for c in cur.description]) is None
