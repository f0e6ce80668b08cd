"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; every run of ``gram`` words has a hash, and of each sliding window of hashes the
smallest is kept. A word is hashed once; hashes of grams and minima of windows come from pairs by doubling. The window is so long that any span of ``span`` shared words keeps at least one equal
hash on both sides, so joining kept hashes of documents and benchmark items finds all of them. A hit
is extended: it carries the hashes around it, from which each window of ``span`` words that holds it is
named by its first and last gram (together they cover all its words) and joined with the items' windows. A window that one
gram covers is named by two hashes of it, so that no match rests on a single one.
Items shorter than ``span`` words are one window of their own length and get grams that fit; each length
that occurs (fewer than ``span``) adds a set of grams.

The documents are read once and never shuffled as texts: kept hashes meet the items' in a join that
the planner broadcasts while the items' table is below its threshold and shuffles beyond, and only
hits, with one row per document, are written.

Defined cases: null texts have no words; items without words or with a null id take no part, and an id counts
once however many rows have it; rows that share id and text are judged alike, each in a row of its own;
rows with a null id are judged like any other; empty tables work on either side; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tables import two, write

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; no words for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def _indices(size: Column) -> Column:
    return F.when(size >= 1, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _folded(values: Column, width: int, meet, body, size: int = 1, total: Column | None = None, done: int = 0) -> Column:
    """``body`` of what each ``width`` neighbouring values give when put together by doubling, so that a value costs a
    logarithm of the width. What stands near the end has too few neighbours and must be cut or do without."""
    def double(joined: Column | None, count: int) -> Column:
        if size * 2 > width:
            return body(joined)
        return _bound(F.zip_with(values, _shifted(values, size), meet), lambda x: _folded(x, width, meet, body, size * 2, joined, count))
    if not width & size:
        return double(total, done)
    if total is None:
        return double(values, size)
    return _bound(F.zip_with(total, _shifted(values, done), meet), lambda x: double(x, done + size))


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _cut(values: Column, width: int) -> Column:
    """Without the positions that have fewer than ``width`` values from there on."""
    return F.slice(values, 1, F.greatest(F.size(values) - (width - 1), F.lit(0)))


def _kept(hashes: Column, width: int) -> Column:
    """Positions (from 1) whose hash is the smallest of some window: it equals the greatest of the minima of its windows."""
    def around(minima: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(None).cast("long"), width - 1), _cut(minima, width))

    def equal(top: Column) -> Column:
        return F.filter(_indices(F.size(hashes)), lambda i: F.element_at(hashes, i) == F.element_at(top, i))
    return _folded(hashes, width, _least, lambda m: _bound(around(m), lambda x: _folded(x, width, _greatest, equal)))


def _second(column: str, length: int):
    """Another hash of the ``length`` words from a position, for windows that one gram covers."""
    return lambda i: F.xxhash64(F.lit(length), F.slice(column, i, length))


def _item(column: str, ahead: int = 0):
    return lambda i: F.element_at(F.col(column), i + ahead)


def _ends(head, tail):
    return lambda i: F.struct(head(i).alias("head"), tail(i).alias("tail"))


def _around(n: int, gram: int):
    """A kept position with the hashes that the windows around it begin and end with."""
    reach = n - _gram_of(n, gram)

    def make(p):
        start = F.greatest(F.lit(1), p - reach)
        mark = F.element_at(F.col(f"g{n}"), p)
        around = F.slice(f"g{n}", start, p + reach - start + 1) if reach else F.array(mark, _second("words", n)(p))
        return F.struct(F.lit(n).alias("length"), mark.alias("mark"), start.alias("start"), (p - start + 1).alias("place"), around.alias("around"))
    return make


def _gram_of(length: int, gram: int) -> int:
    """Words per gram for windows of ``length`` words: first and last gram must cover the window."""
    return length if length <= gram else max(gram, (length + 1) // 2)


def _with_hashes(rows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Adds ``g<length>``, the gram hashes, and ``p<length>``, the positions (from 1) whose hash is the smallest of some window."""
    rows = rows.withColumn("w", F.transform("words", lambda x: F.xxhash64(x)))
    sizes = {n: _gram_of(n, gram) for n in lengths}
    rows = rows.withColumns({f"g{n}": _folded(F.col("w"), m, _hash, lambda x, m=m: _cut(x, m)) for n, m in sizes.items()}).drop("w")
    return rows.withColumns({f"p{n}": _kept(F.col(f"g{n}"), n - m + 1) for n, m in sizes.items()})


def items(benchmark: DataFrame, span: int) -> DataFrame:
    """``item_id, words, length``: items with words; ``length`` is that of their windows."""
    rows = benchmark.select(F.col("item_id"), words(F.col("text").cast("string")).alias("words")).where("item_id is not null")
    return rows.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(span)))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, gram: int = 8, share: int = 20) -> DataFrame:
    """``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    ``contaminated``: hit words are at least one in ``share`` of the words, and at least one.
    """
    if span < 1 or gram < 1 or share < 1:
        raise ValueError("span, gram and share must be positive")
    bench = write(items(benchmark, span), "items")
    lengths = sorted(r.length for r in bench.select("length").distinct().collect())  # at most span values
    marks, windows = _index(bench, lengths, gram)
    found = _meet(docs, marks, lengths, gram)
    key = ["doc_key", "text_key"]
    hits = write(_extend(found.where("around is not null"), windows, lengths, gram), "hits")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*key, "start", "length").distinct().withColumn("fresh", F.greatest(
        F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
    counts = spans.groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    ids = hits.select(*key, F.col("item_id").cast("string").alias("item")).groupBy(*key).agg(F.collect_set("item").alias("ids"))
    per = write(counts.join(ids, key), "contaminated")
    rows = found.where("first").select("doc_id", *key, "n_words").join(per, key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.array_join(F.array_sort(F.coalesce("ids", F.array().cast("array<string>"))), ",")
    return rows.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                       F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                       ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def _index(bench: DataFrame, lengths: list[int], gram: int) -> tuple[DataFrame, DataFrame]:
    """The items' kept hashes ``length, mark`` and their windows ``length, head, tail, item_id``."""
    schema = bench.select("item_id", "length").schema
    marks = bench.sparkSession.createDataFrame([], "length int, mark long")
    windows = bench.sparkSession.createDataFrame([], schema).selectExpr("length", "0L head", "0L tail", "item_id")
    for n in lengths:
        rows = _with_hashes(bench.where(F.col("length") == n), [n], gram)
        last = n - _gram_of(n, gram)
        pick = F.transform(f"p{n}", _item(f"g{n}"))
        marks = marks.union(rows.select(F.lit(n), F.explode(pick)))
        tail = _item(f"g{n}", last) if last else _second("words", n)
        ends = F.transform(_indices(F.size(f"g{n}") - last), _ends(_item(f"g{n}"), tail))
        windows = windows.union(rows.select("item_id", F.explode(ends).alias("w")).select(F.lit(n), "w.head", "w.tail", "item_id"))
    return write(marks.distinct(), "marks"), write(windows.distinct(), "windows")


def _meet(docs: DataFrame, marks: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Each document's first row, and one for each kept hash that an item has too.

    ``doc_key`` and ``text_key`` name a text for joins; results depend on the text alone, so -1 may stand for null.
    ``start`` is the position of the first gram in ``around``, ``place`` that of the hit there.
    """
    rows = two(docs).select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    rows = _with_hashes(rows, lengths, gram)
    kept = [F.array(F.struct(F.lit(0).alias("length"), F.lit(None).cast("long").alias("mark"), F.lit(0).alias("start"),
                             F.lit(0).alias("place"), F.lit(None).cast("array<bigint>").alias("around")))]
    for n in lengths:
        kept.append(F.transform(f"p{n}", _around(n, gram)))
    out = rows.select("doc_id", "doc_key", "text_key", F.size("words").alias("n_words"), F.posexplode(F.concat(*kept)).alias("at", "k"))
    out = out.select("doc_id", "doc_key", "text_key", "n_words", (F.col("at") == 0).alias("first"), "k.*")
    met = out.join(marks.withColumn("met", F.lit(True)), ["length", "mark"], "left").where("first or met")
    return write(met.select("doc_id", "doc_key", "text_key", "n_words", "first", "length", "start", "place", "around"), "met")


def _extend(hits: DataFrame, windows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Windows around the hits that some item has: ``doc_key, text_key, start, length, item_id``."""
    reach = F.lit(0)
    for n in lengths:
        reach = F.when(F.col("length") == n, max(1, n - _gram_of(n, gram))).otherwise(reach)
    rows = hits.withColumn("reach", reach)
    steps = F.transform(_indices(F.least(F.col("place"), F.size("around") - F.col("reach"))), lambda i: F.struct(
        (F.col("start") + i - 1).alias("start"), F.element_at("around", i).alias("head"),
        F.element_at(F.col("around"), i + F.col("reach")).alias("tail")))
    rows = rows.select("doc_key", "text_key", "length", F.explode(steps).alias("s")).select("doc_key", "text_key", "length", "s.*").distinct()
    return rows.join(windows, ["length", "head", "tail"]).select("doc_key", "text_key", "start", "length", "item_id").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    bad = contamination(docs, benchmark, **settings).where("contaminated")
    bad = write(bad.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]), "left_anti")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: All windows of all texts, met as strings.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 13) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, list_aggregate(ws[s:s + n - 1], 'string_agg', ' ') AS w
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, list_aggregate(ws[s:s + n - 1], 'string_agg', ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i))),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
