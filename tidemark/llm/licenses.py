"""Licence scan: fuzzy search for short notices by exact seeds and bounded-error verification.

A text becomes its lower-cased words with one space between. A notice that stands there with at most ``k``
character edits leaves at least one of ``k + 1`` pieces of it untouched, so exact searches for the pieces
find every place worth a look. Only the stretch of text around each seed that could hold the notice, widened to
whole words, is searched by the regex library with at most ``k`` insertions, deletions or substitutions; a match
begins and ends with a word. Of the matches that overlap, those with fewer edits go first, then the earlier ones; what is
left does not overlap. A stretch is as long as the notice and some, so time grows with the text alone, whatever repeats in it.
Spans are reported in words.

The base phrases are the notices that must stand there word for word; their places are counted exactly.

Defined cases: a null or wordless text has no words, places or labels and score 0; very long texts are searched
whole; repeated rows are scanned alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.tables import two

#: Phrase and label of the base search.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Fixed values of the production search: notice, label, edits.
NOTICES = [
    ("under the mit license", "mit", 2),
    ("permission is hereby granted free of charge", "mit", 3),
    ("apache license version 2", "apache-2", 2),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("all rights reserved", "reserved", 1),
    ("released into the public domain", "public-domain", 2),
]


@dataclass
class Notice:
    phrase: str
    label: str
    edits: int

    def __post_init__(self):
        cuts = [len(self.phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        if not all(s for _, s in self.seeds):
            raise ValueError("a notice needs more characters than edits")
        self.patterns = [regex.compile(rf"(?<![^ ])(?:{regex.escape(self.phrase)}){{e<={k}}}(?![^ ])") for k in range(self.edits + 1)]

    def windows(self, text: str) -> list[tuple[int, int]]:
        """For each seed the stretch of ``text``, widened to whole words, that could hold the notice around it."""
        found = set()
        for offset, seed in self.seeds:
            at = text.find(seed)
            while at >= 0:
                lo = max(0, at - offset - self.edits)
                found.add((max(0, text.rfind(" ", 0, lo + 1)), at - offset + len(self.phrase) + self.edits))
                at = text.find(seed, at + 1)
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            # Seeds of one word begin alike: the longest of their stretches holds the others.
            end = text.find(" ", hi)
            end = len(text) if end < 0 else end
            if out and out[-1][0] == lo:
                out[-1] = (lo, max(end, out[-1][1]))
            else:
                out.append((lo, end))
        return out

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, stop, edits)`` of verified places, in characters; they do not overlap."""
        found = set()
        for lo, hi in self.windows(text):
            for edits, pattern in enumerate(self.patterns):
                near = [(m.start(), m.end()) for m in pattern.finditer(text, lo, hi, overlapped=True) if m.end() > m.start()]
                if near:
                    found.update((edits, a, b) for a, b in near)
                    break
        taken: list[tuple[int, int]] = []
        out = []
        for edits, a, b in sorted(found):
            i = bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(i, (a, b))
                out.append((a, b, edits))
        return sorted(out)


class _Count:
    """How many spaces stand before rising positions of a text, counting on from the last one."""

    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, 0

    def before(self, position: int) -> int:
        self.n += self.text.count(" ", self.at, position)
        self.at = position
        return self.n


def scan_text(text: str, base: list[tuple[str, str]], notices: list[Notice]) -> tuple[list[tuple], list[tuple]]:
    """Base places ``(word, label)`` and notice places ``(label, word, words, edits, length)`` of spaced words."""
    inside = f" {text} "
    places = []
    for phrase, label in base:
        count = _Count(inside)
        at = inside.find(f" {phrase} ")
        while at >= 0:
            places.append((count.before(at), label))
            at = inside.find(f" {phrase} ", at + 1)
    found = []
    for n in notices:
        count = _Count(text)
        for a, b, edits in n.matches(text):
            word = count.before(a)
            found.append((n.label, word, count.before(b) - word + 1, edits, len(n.phrase)))
    return places, found


_SPAN = pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())),
                     ("spans", pa.list_(_SPAN))])


def scan(docs: DataFrame, base: list[tuple[str, str]] | None = None, notices: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """``doc_id, n_words, base`` (words where base phrases start), ``base_labels, spans`` of every row."""
    phrases = BASE if base is None else base
    known = [Notice(*n) for n in (NOTICES if notices is None else notices)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in K.blocks(rows.column(1)):
                w = K.Words(texts, K.NON_ALNUM)
                out: list[list] = [[], [], []]
                for first, count in zip(w.first.tolist(), w.count.tolist(), strict=True):
                    text = w.data[w.start[first]:w.end[first + count - 1]].tobytes().decode() if count else ""
                    places, found = scan_text(text, phrases, known) if count else ([], [])
                    out[0].append(sorted(p for p, _ in places))
                    out[1].append(sorted({label for _, label in places}))
                    out[2].append([{"label": x, "word": at, "words": n, "edits": e, "score": 1 - e / size} for x, at, n, e, size in found])
                yield K.batch(_SCHEMA, rows.column(0).slice(a, b - a), w.count.astype(np.int64), *out)
    return two(docs).mapInArrow(run, "doc_id long, n_words long, base array<long>, base_labels array<string>, spans array<struct<"
                                     "label string, word long, words long, edits long, score double>>")


def digest(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    every = F.array_sort(F.array_union("base_labels", F.col("spans.label")))
    best = F.coalesce(F.when(F.size("base") > 0, F.lit(1.0)), F.array_max("spans.score"), F.lit(0.0))
    return scan(docs, **settings).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), best.alias("score"))
