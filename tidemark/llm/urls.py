"""URL filter: a trie over reversed host labels and path segments, longest match first.

A rule ``host/path`` fits its host and all subdomains when the URL's path starts with the rule's
path. The trie walks the host's labels from the last to the first, then the path segment by segment;
the final piece of a rule's path may end inside a segment, as a prefix does. Of all fitting rules the
longest wins; equal lengths go to the longer host, then to ``block``.

The trie is sent to the tasks, so its size is checked: beyond ``max_rules_bytes`` the URLs' host
suffixes and path prefixes are joined with the rule table instead, with the same results.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule; empty
labels are labels; only A-Z is lower-cased; a port or user part belongs to the host, so it fits no
rule; repeated rows are judged alike; repeated rules count once, and of contradicting ones ``block``
holds; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the production rule set: verdict, host and path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MAX_RULES_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Nested dictionaries: host labels from the right, ``None`` leads to the path segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in sorted(rules, key=lambda r: r[0] != "allow"):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[last] = (verdict, host + path, len(host))

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """``(verdict, rule)`` of the longest fitting rule."""
        best: tuple | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(None)
            for segment in segments:
                if below is None:
                    break
                for last, (verdict, rule, width) in below.get(None, {}).items():
                    if segment.startswith(last):
                        rank = (len(rule), width, verdict == "block")
                        best = max(best or (rank,), (rank, verdict, rule))
                below = below.get(segment)
        return best and best[1:]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, by the rules of the module's docstring."""
    known = url.isNotNull() & url.contains("://")
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow",
          key: str = "page_id", url: str = "url", max_rules_bytes: int = MAX_RULES_BYTES) -> DataFrame:
    """``key, host, path, rule, verdict``: the rule's verdict, else ``default``."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    parts = pages.select(F.col(f"`{key}`").alias(key), host.alias("host"), path.alias("path"))
    if sum(len(h.encode()) + len(p.encode()) + 200 for _, h, p in rules) > max_rules_bytes:
        return _joined(parts, pages.sparkSession.createDataFrame(rules, "verdict string, rhost string, rpath string"), key, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [trie.value.judge(h, p) or (default, None) for h, p in zip(
                rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([f[1] for f in found], pa.string()),
                                              pa.array([f[0] for f in found], pa.string())],
                                             names=[key, "host", "path", "rule", "verdict"])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInArrow(run, f"{kind}, rule string, verdict string")


def _joined(parts: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """The same by joins: every suffix of a distinct host meets the rules of that host."""
    best = rules.groupBy("rhost", "rpath").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = (parts.select("host", "path").distinct()
                .withColumn("rhost", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(
                    ".", F.slice(labels, i, F.size(labels)))))))
    fits = suffixes.join(best, "rhost").where(F.startswith("path", "rpath"))
    rank = F.struct((F.length("rhost") + F.length("rpath")).alias("n"), F.length("rhost").alias("h"), "verdict",
                    F.concat("rhost", "rpath").alias("rule"))
    won = fits.groupBy("host", "path").agg(F.max(rank).alias("won"))
    return (parts.join(won, ["host", "path"], "left")
            .select(key, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")))


#: Rules written out; the longest of those that fit wins.
ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
