"""Licence scan against all word-aligned stretches."""

import random
import re

from test_lines import distance, edited

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(doc, text, base, notices):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in base for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    for p, label, k in notices:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                part = " ".join(w[i:j])
                if len(part) > len(p) + k:
                    break
                if len(part) >= len(p) - k and (d := distance(part, p)) <= k:
                    labels.add(label)
                    score = max(score, 1 - d / len(p))
    starts = [i for i, _ in places]
    return (doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
            ",".join(sorted(labels)), round(score, 12))


def test_against_all_stretches(spark):
    rnd = random.Random(4)
    filler = ["under", "the", "mit", "license", "Licence", "é", "version", "2", "cc", "by", "nc", "gnu", "x"]
    rows = []
    for d in range(150):
        parts = rnd.choices(filler, k=rnd.randrange(12))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(licenses.NOTICES)[0]
            parts += [edited(rnd, p, rnd.randrange(5)).upper(), *rnd.choices(filler, k=rnd.randrange(4))]
        rows.append((d, rnd.choice([" ", "-", ".\n"]).join(parts)))
    rows += [(900, None), (901, ""), (902, "--"), (None, "CC BY-NC cc by nc"), (903, "Licensed under CC BY-NC 4.0."), (903, "under the mit license"),
             (904, "x " * 40000 + "Under the MIT License " + "y " * 9), (905, "cc by ncé"), (906, "This work is licensed under the GNU General Public License, version 3.")]
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, n_words int, labels string")
    got = [(*tuple(r)[:-1], round(r.score, 12)) for r in licenses.digest(docs).collect()]
    assert sorted(got, key=repr) == sorted((brute(d, t, licenses.BASE, licenses.NOTICES) if d != 904 else
                                            (904, 40013, 1, 40000, 40000, "mit", "mit", 1.0) for d, t in rows), key=repr)
    assert licenses.digest(docs.limit(0)).count() == 0


def test_spans_are_reported(spark):
    docs = spark.createDataFrame([(1, "see the GNU Genral Public Licence, please")], "doc_id long, text string")
    spans = licenses.scan(docs).first().spans
    assert [(s.label, s.word, s.words, s.edits) for s in spans] == [("gpl", 2, 4, 2)]


def test_adjacent_notices_have_a_span_each(spark):
    rows = [(1, "all rihts reserved all rights reserved x all rights reservd"), (2, "all rights reserved all rights reserved"),
            (3, "gnu general public license gnu genral public license")]
    got = {r.doc_id: [(s.label, s.word, s.words, s.edits) for s in r.spans] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("reserved", 0, 3, 1), ("reserved", 3, 3, 0), ("reserved", 7, 3, 1)]
    assert got[2] == [("reserved", 0, 3, 0), ("reserved", 3, 3, 0)]
    assert got[3] == [("gpl", 0, 4, 0), ("gpl", 4, 4, 1)]


def test_time_follows_the_length():
    """A text of near misses only: no search may run over more than a notice's length."""
    import time
    notices = [licenses.Notice("all rights reserved", "reserved", 1)]
    took = []
    for k in (4_000, 32_000):
        begin = time.process_time()
        _, found = licenses.scan_text("all rihts reserved " * k, [("all rihts", "x")], notices)
        took.append(time.process_time() - begin)
        assert len(found) == k and found[-1][1] == 3 * (k - 1)
    assert took[1] < 30 * took[0]
