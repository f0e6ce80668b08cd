"""Names of all but two ranges: no pair within two edits may be missed, and none of a crowd may be paired."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lines import distance

from tidemark.llm import families


def changed(rnd, line, edits, pool):
    x = list(line)
    for _ in range(edits):
        i = rnd.randrange(len(x))
        if rnd.random() < 0.5:
            x[i] = rnd.choice(pool)
        elif len(x) > 12 and rnd.random() < 0.6:
            del x[i]
        else:
            x.insert(i, rnd.choice(pool))
    return "".join(x)


def connected(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def left_out(line):
    return {line[:i] + line[i + 1:] for i in range(len(line))}


@pytest.mark.parametrize(("bucket", "pool"), [(64, "abc"), (4, "abc"), (2, "ab語é"), (3, "0123456789")])
def test_all_pairs_within_two_edits_connect(spark, bucket, pool):
    rnd = random.Random(bucket)
    base = "".join(rnd.choices("abcdefgh ", k=37))
    lines = sorted({changed(rnd, base, rnd.randrange(5), pool) for _ in range(160)})
    rows = [((i, -i), x.encode(), i) for i, x in enumerate(lines)]
    table = spark.createDataFrame(rows, "id struct<h1:long,h2:long>, body binary, root long").repartition(3)
    got = families.pairs(table, lambda b: b.decode(), 12, bucket).select("a.h1", F.col("b.h1").alias("other")).collect()
    true = [(a, b) for a, b in got if distance(lines[a], lines[b]) <= 2]
    # Lines that leave a common one when a unit goes from each are an equality of their own.
    outs = [left_out(x) for x in lines]
    near = [(a, b) for a in range(len(lines)) for b in range(a) if outs[a] & outs[b]]
    wanted = [(a, b) for a in range(len(lines)) for b in range(a) if len(lines[a]) >= 12 and distance(lines[a], lines[b]) <= 2]
    assert classes(len(lines), true + near) == classes(len(lines), wanted + near)


def classes(n, links):
    root, out = connected(n, links), {}
    for i, r in enumerate(root):
        out.setdefault(r, []).append(i)
    return sorted(out.values())


def test_a_crowd_is_not_paired(spark):
    """Two slots of one unit at the two ends: thousands of pairs within two edits, one link for each line."""
    body = "x" + "the same middle of all lines " * 4 + "y"
    units = [chr(0x4E00 + i) for i in range(40)]
    lines = [a + body[1:-1] + b for a in units for b in units]
    rows = [((i, i), x.encode(), i) for i, x in enumerate(lines)]
    table = spark.createDataFrame(rows, "id struct<h1:long,h2:long>, body binary, root long").repartition(3)
    got = families.pairs(table, lambda b: b.decode(), 12, 64).select("a.h1", F.col("b.h1").alias("other")).collect()
    assert len(got) < 130 * len(lines) and len(set(connected(len(lines), got))) == 1


def test_masks_shrink_to_units_and_gaps():
    for size in (12, 13, 40):
        masks = {tuple(m) for m in families.first_masks(size, 10).tolist()}
        for _ in range(6):
            masks = {f for m in masks for f in families.finer(m)}
        assert families.is_done(np.array(sorted(masks))).all()
        for kind, (one, two) in enumerate(families._DELETES):
            own = {m[3:] for m in masks if m[0] == kind and m[1]}
            for i in range(size + one):
                for j in range(i + (kind == 0 or kind == 2), size + two):
                    a, b = (i, i if one else i + 1), (j, j if two else j + 1)
                    assert (*a, *b) in own, (kind, i, j)
