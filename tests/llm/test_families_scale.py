"""Pairs of lines in crowded names: few are sent on to be compared, and none that two edits connect is lost."""

import random

from test_lines import distance, edited

from tidemark.llm import families


def test_two_edits_change_four_bits_at_most():
    rnd = random.Random(4)
    for _ in range(500):
        line = "".join(rnd.choices("abé語“ xyz0123", k=rnd.randrange(1, 40)))
        other = edited(rnd, line, 2)
        if distance(line, other) <= 2:
            assert (families.sign(line) ^ families.sign(other)).bit_count() <= 4
        a, b = line.encode(), edited(rnd, line, 1).encode()
        if distance(a, b) <= 2:
            assert (families.sign(a) ^ families.sign(b)).bit_count() <= 4


def test_lines_that_differ_in_many_units_are_not_paired(spark):
    rnd = random.Random(2)
    end = "the end that is common to every line of this family, all of it"
    texts = sorted({"".join(rnd.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", 12)) + end for _ in range(40)})
    rows = [((i, i), x.encode(), i) for i, x in enumerate(texts)] + [((100, 100), ("12" + texts[0][2:]).encode(), 100)]
    lines = spark.createDataFrame(rows, "id struct<h1: long, h2: long>, body binary, root long")
    found = {(r.a.h1, r.b.h1) for r in families.pairs(lines, lambda body: body.decode(), 16, 64).collect()}
    assert (0, 100) in found and len(found) < 20
