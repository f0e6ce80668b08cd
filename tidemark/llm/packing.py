"""Packing by concatenation: all token ids in one stream, cut into windows of a fixed length.

Pass 1 tokenises every document once and writes its ids with the partition that held it and the
ids before it there. Pass 2 turns the partition totals into global offsets by prefix sums, in two
levels so that no window holds them all, and cuts each document at the multiples of ``length``: one
boundary record per piece. Only the last sequence is not full.

Ids are those of a tokenizer file. For a byte-level BPE whose merges make the ids in their order, merging by the
smallest id gives the same as merging by rank, so its vocabulary is handed to the quicker rank encoder; any other
file is encoded by the tokenizers library itself, and so is every text that holds an added token of the file or a run of
white space on which the rank encoder's pattern could overflow. Tests hold both against each other.

Special tokens of the file that stand in a text are its plain characters, or with ``added`` their own ids, as the
tokenizers library gives them by default.

Defined cases: a null or empty text has only the closing id; rows with a null or repeated id are
packed like any other; the row order is that of the written partitions; an empty table gives an
empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tables import two, write

ROWS = 500
#: Fixed value: the pattern by which byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Partition totals are sent to the tasks up to this many (16 bytes each); more are joined.
SENT_TOTALS = 2_000_000
_GROUP = 1024
#: Longer runs of white space go to the tokenizers library: the rank encoder's pattern keeps one state per character of a
#: run, of at most 1,000,000, and fails beyond.
SAFE_RUN = 100_000
_SPACES = re.compile(r"\s+")
_encoders: dict[tuple[str, bool], Encoder] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def ranks(file: dict) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level BPE file whose ids follow its merges; None for any other."""
    model, split = file.get("model", {}), file.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
             and split.get("use_regex", True) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                                                 "ignore_merges", "byte_fallback")))
    if not plain:
        return None
    byte, vocab = _byte_of(), model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    first = sorted(vocab[c] for c in byte if c in vocab)
    if first != list(range(256)) or [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    return {bytes(byte[c] for c in t): vocab[t] for t in [*byte, *merged]}


class Encoder:
    """Token ids as bytes, by a tokenizer file; kept in the worker between tasks."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        found = ranks(file)
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = not added
        self.size = len(found) if found else self.own.get_vocab_size()
        tokens = [t for t in file.get("added_tokens") or [] if added or not t["special"]]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in tokens)) if tokens else None
        self.quick = None
        if found:
            import tiktoken

            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found, special_tokens={}).encode_ordinary
        small = max([self.size, *(t["id"] + 1 for t in tokens)]) <= 1 << 16
        self.kind, self.code = (np.uint16, "H") if small else (np.uint32, "I")

    def ids(self, text: str) -> list[int]:
        if self.quick and not (self.added and self.added.search(text)) and not (
                len(text) > SAFE_RUN and any(m.end() - m.start() > SAFE_RUN for m in _SPACES.finditer(text))):
            return self.quick(text)
        return self.own.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return array(self.code, self.ids(text)).tobytes()


def encoder(path: str | None, added: bool = False) -> Encoder:
    """The worker's encoder; the default file is looked up on the worker itself."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def tokens(docs: DataFrame, path: str | None = None, end: int = 0, added: bool = False) -> DataFrame:
    """``doc_id, part, before, n, ids``: ids as bytes with the closing id, and the ids before them there."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("n", pa.int64()),
                        ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, added)
        part, before = TaskContext.get().partitionId(), 0
        close = np.array([end], enc.kind).tobytes()
        for rows in batches:
            for lo in range(0, rows.num_rows, ROWS):
                some = rows.slice(lo, ROWS)
                ids = [enc.encode(t or "") + close for t in some.column(1).to_pylist()]
                n = np.array([len(x) // len(close) for x in ids], np.int64)
                begin = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(begin),
                                                  pa.array(n), pa.array(ids, pa.binary())], schema=schema)
    return two(docs).mapInArrow(run, "doc_id long, part long, before long, n long, ids binary")


def _offsets(written: DataFrame) -> DataFrame:
    """``part, offset``: prefix sums of the partition totals, within groups and over the groups."""
    totals = written.groupBy("part").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("part") / _GROUP))
    inside = totals.withColumn("inner", F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n"))
    groups = totals.groupBy("group").agg(F.sum("n").alias("n"))
    outside = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("outer"))
    return write(inside.join(outside, "group").select("part", (F.col("inner") + F.col("outer")).alias("offset")), "offsets")


def pack(docs: DataFrame, length: int = 1024, path: str | None = None, end: int = 0, with_ids: bool = False,
         added: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids``."""
    if length < 1:
        raise ValueError("length must be positive")
    written = write(tokens(docs, path, end, added), "tokens")
    offsets = _offsets(written)
    if offsets.count() <= SENT_TOTALS:
        offsets = F.broadcast(offsets)
    placed = written.join(offsets, "part").select("doc_id", "n", "ids", (F.col("offset") + F.col("before")).alias("at"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            doc = rows.column(0).to_pylist()
            out: list[list] = [[] for _ in names]
            for d, n, ids, at in zip(doc, *(rows.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                wide = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    took = min(length - offset, n - start)
                    piece = wide[4 * start:4 * (start + took)]
                    for column, value in zip(out, (d, start, took, zlib.crc32(piece), n, sequence, offset, piece), strict=False):
                        column.append(value)
                    start += took
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)
    return placed.mapInArrow(cut, ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names))
