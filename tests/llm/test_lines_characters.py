"""Line deduplication by characters, with short lines by equality, against an all-pairs version."""

import hashlib
import random

import pytest
from test_lines import distance, edited

from tidemark.llm import catalog, lines


def brute(rows, limit, least, exact):
    units = [(d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if len(x.encode()) >= exact]
    distinct = sorted({x for *_, x in units})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fuzzy = [x for x in distinct if len(x) >= least]
    for i, x in enumerate(fuzzy):
        for y in fuzzy[:i]:
            if abs(len(x) - len(y)) <= limit and distance(x, y) <= limit:
                root[find(x)] = find(y)
    head = {}
    for d, i, x in units:
        head[find(x)] = min(head.get(find(x), (d, i)), (d, i))
    out = []
    for d, t in rows:
        parts = t.split("\n")
        kept = [x for i, x in enumerate(parts) if len(x.encode()) < exact or head[find(x)] == (d, i)]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def family(rnd, n):
    base, out = "common lïne of 語 many copies", []
    for _ in range(n):
        x = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            x[rnd.randrange(len(x))] = rnd.choice("語é“ab")
        out.append("".join(x))
    return out


@pytest.mark.parametrize(("limit", "bucket"), [(1, 4), (2, 64), (2, 3), (3, 5)])
def test_against_all_pairs(spark, limit, bucket):
    rnd = random.Random(limit)
    base = ["".join(rnd.choices("abé語“ ", k=rnd.randrange(1, 40))) for _ in range(25)]
    rows = [(d, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])).replace("a", rnd.choice("a語"), 1)
                          for _ in range(rnd.randrange(6)))) for d in range(60)]
    rows += [(100 + i, x) for i, x in enumerate(family(rnd, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lines.digest(docs, max_edits=limit, min_bytes=10, bucket=bucket, characters=True, exact=1).collect()
    assert sorted(map(tuple, got)) == brute(rows, limit, 10, 1)


def query(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [r.n_removed for r in sorted(catalog.op9_lines(spark, str(tmp_path)).collect())]


def test_query_takes_two_characters(spark, tmp_path):
    long = "a line of more than thirty-two characters, page 17, " * 6
    texts = [long, long.replace("17", "28", 1), long.replace("e", "é", 1), long + "語", long.replace("17", "289", 1) + "xy",
             "the café of the town at the river 1", "the cafe of the town at the river 2"]
    assert query(spark, tmp_path, texts) == [0, 1, 1, 1, 0, 0, 1]


def test_query_cuts_short_repeats(spark, tmp_path):
    assert query(spark, tmp_path, ["ok\n\nshare this\nonly here", "share this\n\nok", "sharE this\n語", "語\nok"]) == [0, 2, 0, 2]
