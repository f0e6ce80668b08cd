"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Equal vectors collapse to one that keeps its smallest ids, so a hot vector is one node. Distinct vectors are
dealt to shards of bounded size. A shard's graph has layers, each a random part of the one below; a node is linked
to near nodes that are nearer to it than to each other, and links are kept both ways up to a fixed degree. Layers
are built from the top, in batches that search what is there. A graph is stored as flat neighbour arrays
(node ids and a rectangular matrix per layer), with its vectors, as one row of bounded size.

Queries descend the layers of every shard, in blocks of bounded size; found nodes get their distance anew, in
double precision on the original vectors, and the shards' best are merged by (distance, id).

Defined cases: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components,
take no part; vectors of another length are never neighbours; rows equal in id and vector count once; a query is no neighbour of
its own id; ties go to the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.tables import write

SHARD_ROWS, QUERY_BLOCK, BATCH = 8192, 1024, 256
DEGREE, BUILD_BEAM, BEAM = 16, 96, 256


def _distances(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own nodes ``at`` (queries x nodes)."""
    near = x[at]
    near -= q[:, None, :]
    return np.einsum("bkd,bkd->bk", near, near)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, width: int = 4):
    """Nearest nodes of many queries at once, ``(ids, squared distances)``; unused places are -1 and infinite.

    ``links`` is the layer's neighbour matrix by node, -1 where empty. Each step opens the ``width`` nearest unopened
    nodes of every query's beam.
    """
    n = len(q)
    rows = np.arange(n)[:, None]
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, np.float32)
    opened = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True
    m = min(entry.shape[1], beam)
    start = entry[:, :m]
    ids[:, :m] = start
    dist[:, :m] = np.where(start >= 0, _distances(x, q, start), np.inf)
    seen[rows, start] = True
    while True:
        waiting = np.where(opened | (ids < 0), np.inf, dist)
        pick = np.argpartition(waiting, min(width, beam) - 1, axis=1)[:, :width]
        live = np.isfinite(waiting[rows, pick])
        if not live.any():
            return ids, dist
        opened[rows, pick] |= live
        # A row without work opens nothing; -1 stands for no node throughout.
        some = np.flatnonzero(live.any(1))
        found = np.where(live[some][:, :, None], links[ids[rows[some], pick[some]]], -1).reshape(len(some), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[seen[some[:, None], found]] = -1
        seen[some[:, None], found] = True
        far = _distances(x, q[some], found)
        far[found < 0] = np.inf
        all_ids = np.concatenate([ids[some], found], 1)
        all_dist = np.concatenate([dist[some], far], 1)
        all_open = np.concatenate([opened[some], np.zeros(found.shape, bool)], 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        line = np.arange(len(some))[:, None]
        ids[some], dist[some], opened[some] = all_ids[line, best], all_dist[line, best], all_open[line, best]
        ids[some] = np.where(np.isfinite(dist[some]), ids[some], -1)


def choose(x: np.ndarray, at: np.ndarray, dist: np.ndarray, degree: int) -> np.ndarray:
    """From candidates of each row, near ones that are nearer to the row's node than to one another.

    Free places go to the nearest of the rest, so that no node is left without links.
    """
    order = np.argsort(dist, axis=1, kind="stable")
    line = np.arange(len(at))[:, None]
    at, dist = at[line, order], dist[line, order]
    usable = np.isfinite(dist)
    near = x[np.where(usable, at, 0)]
    square = np.einsum("bkd,bkd->bk", near, near)
    between = square[:, :, None] + square[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    taken = np.zeros(at.shape, bool)
    closest = np.full(at.shape, np.inf, np.float32)
    for c in range(at.shape[1]):
        take = usable[:, c] & (dist[:, c] < closest[:, c]) & (taken.sum(1) < degree)
        taken[:, c] = take
        closest[take] = np.minimum(closest[take], between[take, c, :])
    rank = np.where(taken, 0, np.where(usable, 1, 2)) * at.shape[1] + np.arange(at.shape[1])
    keep = np.argsort(rank, axis=1)[:, :degree]
    out = np.where(usable[line, keep], at[line, keep], -1)
    if out.shape[1] < degree:
        out = np.concatenate([out, np.full((len(out), degree - out.shape[1]), -1)], 1)
    return out


def _join_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the reverse of new links; a full node chooses again among its old and new neighbours."""
    degree = links.shape[1]
    target, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    while len(target):
        place = np.arange(len(target)) - np.searchsorted(target, target, side="left")
        now = place < degree
        owners, row = np.unique(target[now], return_inverse=True)
        extra = np.full((len(owners), degree), -1)
        extra[row, place[now]] = source[now]
        both = np.concatenate([links[owners], extra], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        dist = _distances(x, x[owners], both)
        dist[both < 0] = np.inf
        full = (both >= 0).sum(1) > degree
        kept = -np.sort(-both, axis=1)[:, :degree]
        if full.any():
            kept[full] = choose(x, both[full], dist[full], degree)
        links[owners] = kept
        source, target = source[~now], target[~now]


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the bottom up: the ids of their nodes and, by position among all nodes, their neighbours."""
    n = len(x)
    level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(degree)).astype(int), 6)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    done = np.zeros(0, np.int64)
    for at in range(level.max(initial=0), -1, -1):
        width = 2 * degree if at == 0 else degree
        links = np.full((n + 1, width), -1)
        fresh = np.flatnonzero(level == at)
        todo = np.concatenate([done, fresh])
        lo = 0
        while lo < len(todo):
            batch = todo[lo:lo + BATCH]
            dist = _square(x, batch)
            np.fill_diagonal(dist, np.inf)
            at_ids = np.broadcast_to(batch, dist.shape)
            if lo:
                entry = _descend(x, layers, x[batch], todo[:1])
                # Upper nodes enter a layer before the others; an entry that is not yet linked gives way to the first.
                entry = np.where(np.isin(entry, todo[:lo]), entry, todo[0])
                ids, far = beam_search(x, links[:-1], x[batch], entry, beam)
                at_ids, dist = np.concatenate([at_ids, ids], 1), np.concatenate([dist, far], 1)
            some = min(2 * beam // 3, dist.shape[1])
            best = np.argpartition(dist, some - 1, axis=1)[:, :some]
            line = np.arange(len(batch))[:, None]
            chosen = choose(x, at_ids[line, best], dist[line, best], degree)
            links[batch, :degree] = chosen
            _join_back(x, links, batch, chosen)
            lo += len(batch)
        done = todo
        layers.insert(0, (todo, links[:-1]))
    return layers


def _square(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = x[at]
    s = np.einsum("bd,bd->b", v, v)
    return np.maximum(s[:, None] + s[None, :] - 2 * v @ v.T, 0)


def _descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, first: np.ndarray, beam: int = 8) -> np.ndarray:
    """Entry nodes of each query from the upper ``layers`` (bottom first)."""
    entry = np.broadcast_to(first if not layers else layers[-1][0][:1], (len(q), 1))
    for _, links in reversed(layers):
        ids, dist = beam_search(x, links, q, entry, beam)
        entry = ids[np.arange(len(q)), dist.argmin(1)][:, None]
    return entry


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Ids of about the ``k`` nearest nodes of each query, nearest first, -1 where there are no more."""
    entry = _descend(x, layers[1:], q, layers[0][0][:1])
    ids, dist = beam_search(x, layers[0][1], q, entry, max(beam, k))
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return ids[np.arange(len(q))[:, None], order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part, each pair once."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0)).distinct()


def index(vectors: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row per shard: ``dim, shard, ids`` (the ``k + 1`` smallest of each node), vectors and layers; and the shard count."""
    row = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = vectors.withColumn("row", row).where(F.col("row") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = write(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).alias("shard"), "ids", "v")

    def make(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("v"))
        layers = build(x.astype(np.float32))
        return pa.table({"dim": group.column("dim").slice(0, 1), "shard": group.column("shard").slice(0, 1),
                         "ids": pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([x.tobytes()], pa.binary()),
                         "nodes": pa.array([[a.astype(np.int32).tobytes() for a, _ in layers]], pa.list_(pa.binary())),
                         "links": pa.array([[b[a].astype(np.int32).tobytes() for a, b in layers]], pa.list_(pa.binary()))})
    kind = "dim int, shard long, ids array<array<long>>, vectors binary, nodes array<binary>, links array<binary>"
    return write(dealt.groupBy("dim", "shard").applyInArrow(make, kind), "graphs"), shards


def _load(graph: pa.Table) -> tuple[np.ndarray, list]:
    dim = graph.column("dim")[0].as_py()
    x = np.frombuffer(graph.column("vectors")[0].as_py()).reshape(-1, dim)
    layers = []
    for nodes, links in zip(graph.column("nodes")[0].as_py(), graph.column("links")[0].as_py(), strict=True):
        at = np.frombuffer(nodes, np.int32).astype(np.int64)
        full = np.full((len(x), len(links) // 4 // len(at)), -1)
        full[at] = np.frombuffer(links, np.int32).reshape(len(at), -1)
        layers.append((at, full))
    return x, layers


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = BEAM,
               key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest found; the score is the Euclidean distance."""
    rows = write(usable(vectors, key, vector), "vectors")
    asked = write(rows if queries is None else usable(queries, key, vector), "queries")
    graphs, shards = index(rows, k, shard_rows)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    split = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks))
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = asked.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                         split.alias("block"), "vec_id", "v")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def look(graph: pa.Table, block: pa.Table) -> pa.Table:
        if not graph.num_rows or not block.num_rows:
            return out.empty_table()
        x, layers = _load(graph)
        members, q, who = graph.column("ids")[0].as_py(), _matrix(block.column("v")), block.column("vec_id").to_pylist()
        found: list[tuple] = []
        small = x.astype(np.float32)
        for lo in range(0, len(q), BATCH):
            part = q[lo:lo + BATCH]
            near = search(small, layers, part.astype(np.float32), 2 * k + 1, beam)
            for i, nodes in enumerate(near):
                nodes = nodes[nodes >= 0]
                exact = np.sqrt(((x[nodes] - part[i]) ** 2).sum(1)).tolist()
                best = sorted((s, m) for s, node in zip(exact, nodes, strict=True) for m in members[node] if m != who[lo + i])
                found += [(who[lo + i], m, s) for s, m in best[:k]]
        return pa.table([pa.array([f[j] for f in found], t.type) for j, t in enumerate(out)], schema=out)
    by = ["dim", "shard", "block"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    merged = best.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def hundredth(vectors: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return vectors.where(F.col("vec_id") % 100 == 0)
