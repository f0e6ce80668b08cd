"""SimHash against a brute-force version with the public xxhash library."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_print(text):
    data = (text or "").encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    w = WORD.findall(data)
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits=2):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        least[k] = d if least.get(k) is None else min(least[k], d if d is not None else least[k])
    return sorted(((d, f, least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def run(spark, rows, **settings):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, root string")
    got = simhash.near_duplicates(docs, **settings).collect()
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["The", "of", "Éa", "x y", "longer" * 9, "z" * 70, "in", "on", "AND", "tion"]
    out = []
    for k in range(60):
        w = rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 8, 40, 400]))
        for _ in range(rnd.choice([1, 1, 2, 4])):
            if w and rnd.random() < 0.6:
                w = list(w)
                w[rnd.randrange(len(w))] = rnd.choice(words)
            out.append((len(out), rnd.choice([" ", "  ", "\n", "\t\r"]).join(w)))
    return out + [(700, None), (700, None), (None, ""), (None, "lone words here only once now"), (9000, " ".join(words * 900))]


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_hot_buckets_go_by_ball_centres(spark, rows):
    assert run(spark, rows, bucket=2) == brute(rows)


def test_links_of_random_neighbours(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(60)}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    wanted = {tuple(sorted((sign(a), sign(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    got = {tuple(sorted(r)) for r in simhash.links(df, bucket=10**6).collect()}
    assert got == wanted
    as_set = lambda links: {(r.node, r.root) for r in components(links).collect()}
    every = spark.createDataFrame(sorted(wanted), "a long, b long")
    assert as_set(simhash.links(df, bucket=2)) == as_set(every)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 300)}}


def test_keep_first_and_empty(spark, rows):
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, value string")
    kept = simhash.keep_first(docs)
    heads = {c for d, _, c in brute(rows) if d is not None and c == d}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(heads) and kept.columns == docs.columns
    assert got.count(None) == 1  # the empty text without an id goes with that of 700
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_keep_first_tells_rows_of_one_id_apart(spark):
    one, two = "a text of its own with some words", "quite another text that says something else"
    rows = [(1, one, 0), (5, one, 1), (5, two, 2), (7, two, 3), (5, two, 4), (None, "third text with no id at all", 5), (None, one, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, head int")
    got = simhash.keep_first(docs)
    assert got.schema == docs.schema
    kept = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert kept == sorted([(1, one), (5, two), (0, "third text with no id at all")])
    assert all(rows[r["head"]] == tuple(r) for r in got.collect())
