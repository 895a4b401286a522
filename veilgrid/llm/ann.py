"""Approximate nearest neighbours by largest inner product, on robust-pruned graphs.

Distinct vectors are dealt by hash into shards. A shard grows with the square root of
the table, up to a bound in bytes, so that searching every shard costs less than one
comparison of all queries with all rows would; every shard goes to a task of its own. In
each shard a directed graph grows in batches: a greedy beam search on the graph so far proposes
neighbours for every new vector, relaxed distance pruning keeps a diverse few of
them (one neighbour hides another that is much nearer to it than to the vector), and
reverse edges are added and pruned likewise. A shard with its graph is sent once for a
chunk of many queries, which stream past it and beam-search it in small blocks; the
best of all shards are scored again in double precision on the original vectors.

Largest inner product becomes least distance by one more coordinate that gives all
vectors of a shard the same length. Equal vectors are one node that stands for its
smallest ids, as many as a result can hold, so copies neither crowd the graph nor
get lost. Vectors that are null, empty or zero, or hold a null or non-finite
component, take no part; queries meet vectors of their own dimension. Where there
are fewer candidates than ``k``, all are returned. Rows that repeat an
id count once for each distinct vector; rows without an id take no part. Columns but
the two named are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.llm.common import Scratch, bound_batches

K, EVERY = 20, 20
#: Vectors of a shard on average: ROOT times the square root of all, at least SHARD, at most what fits SHARD_BYTES.
SHARD, ROOT, SHARD_BYTES = 8192, 64, 256 << 20
#: Queries that search a shard at once, bytes of their visited sets, and bytes of the queries that a shard is sent for.
QUERY_BLOCK, SEEN_BYTES, CHUNK_BYTES = 512, 64 << 20, 64 << 20
#: Edges of a node, beam while building and while searching, and the relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 128, 1.2
#: Salts that pre-select the smallest ids of a hot vector.
SALTS = 64
#: Vectors that enter the graph together at most.
BATCH = 512


def _beam(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that a greedy search meets, for all queries at once: (ids, squared distances); -1 fills."""
    n, size = len(queries), len(points)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf, np.float32)
    seen = np.zeros((n, size + 1), bool)  # the last column takes the fills
    done = np.ones((n, beam), bool)
    q2 = (queries * queries).sum(1)
    p2 = (points * points).sum(1)
    ids[:, 0], near[:, 0], done[:, 0] = entry, q2 + p2[entry] - 2 * queries @ points[entry], False
    seen[:, entry] = True
    live = rows
    while len(live):
        at = np.where(done[live], np.inf, near[live]).argmin(1)
        node = ids[live, at]
        done[live, at] = True
        found = edges[node]
        fresh = (found >= 0) & ~seen[live[:, None], found]
        seen[live[:, None], found] = True
        safe = np.maximum(found, 0)
        gap = q2[live, None] + p2[safe] - 2 * np.einsum("nd,nkd->nk", queries[live], points[safe], optimize=True)
        gap = np.where(fresh, gap, np.inf).astype(np.float32)
        all_near = np.concatenate([near[live], gap], 1)
        all_ids = np.concatenate([ids[live], np.where(fresh, found, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        best = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        near[live], ids[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_near, all_ids, all_done))
        live = live[~done[live].all(1)]
    order = near.argsort(1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _prune(points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning for many nodes at once. ids and near: candidates in order of distance, -1 fills."""
    n, width = ids.shape
    out = np.full((n, degree), -1, np.int64)
    alive = (ids >= 0) & (ids != nodes[:, None])
    held = points[np.maximum(ids, 0)]
    h2 = (held * held).sum(2)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        out[some, k] = ids[rows, first][some]
        chosen = held[rows, first]
        gap = h2 + h2[rows, first][:, None] - 2 * np.einsum("nd,nwd->nw", chosen, held, optimize=True)
        alive &= (alpha * alpha * gap > near) & (np.arange(width)[None, :] != first[:, None])
        alive[~some] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry): a directed graph of bounded degree over the points."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    if n == 1:
        return edges, 0
    p2 = (points * points).sum(1)
    middle = points.mean(0)
    entry = int((p2 - 2 * points @ middle).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        new = order[at : at + max(1, min(at, BATCH))]
        at += len(new)
        ids, near = _beam(points, edges, entry, points[new], beam)
        # what a batch cannot find in the graph yet, it finds among itself
        inner = p2[new][:, None] + p2[new][None, :] - 2 * points[new] @ points[new].T
        np.fill_diagonal(inner, np.inf)
        k = min(degree, len(new) - 1)
        if k:
            own = np.argpartition(inner, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, new[own]], 1)
            near = np.concatenate([near, np.take_along_axis(inner, own, 1).astype(np.float32)], 1)
            by = near.argsort(1)
            ids, near = np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)
        edges[new] = _prune(points, new, ids, near, degree, alpha)
        # reverse edges
        source = np.repeat(new, degree)
        target = edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = target.argsort(kind="stable")
        source, target = source[by], target[by]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        width = degree + int(count.max())
        for lo in range(0, len(nodes), BATCH):
            some = slice(lo, lo + BATCH)
            wide = np.full((len(nodes[some]), width), -1, np.int64)
            wide[:, :degree] = edges[nodes[some]]
            for r, (s, c) in enumerate(zip(start[some], count[some])):
                wide[r, degree : degree + c] = source[s : s + c]
            full = (wide >= 0).sum(1) > degree
            easy = nodes[some][~full]
            if len(easy):
                packed = np.sort(np.where(wide[~full] < 0, n, wide[~full]), 1)[:, :degree]
                packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = n
                edges[easy] = np.where(packed == n, -1, packed)
            hard = nodes[some][full]
            if len(hard):
                w = np.sort(wide[full], 1)
                w[:, 1:][w[:, 1:] == w[:, :-1]] = -1
                gap = p2[hard][:, None] + p2[np.maximum(w, 0)] - 2 * np.einsum("nd,nwd->nw", points[hard], points[np.maximum(w, 0)], optimize=True)
                gap = np.where(w >= 0, gap, np.inf).astype(np.float32)
                by = gap.argsort(1)
                edges[hard] = _prune(points, hard, np.take_along_axis(w, by, 1), np.take_along_axis(gap, by, 1), degree, alpha)
    return edges, entry


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, after which distance orders as inner product does."""
    v = vectors.astype(np.float64)
    length = (v * v).sum(1)
    scale = np.sqrt(length.max()) or 1.0
    v = v / scale
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))[:, None]], 1).astype(np.float32)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part, each pair once."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.select(F.col(id_col).alias("id"), v.alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL").filter(F.coalesce(fine, F.lit(False)))


def _nodes(vectors: DataFrame, shards: int, k: int) -> DataFrame:
    """(shard, vector, ids): every distinct vector with its smallest ids; a hot vector's ids are cut down by salt first."""
    keyed = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    keyed = keyed.dropDuplicates(["vector", "salt", "id"])
    keyed = keyed.withColumn("r", least("vector", "salt")).filter(F.col("r") <= k).withColumn("r", least("vector")).filter(F.col("r") <= k)
    nodes = keyed.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))


def shard_size(n: int, size: int) -> int:
    """Vectors of a shard, for ``n`` vectors of ``size`` components."""
    most = max(1, SHARD_BYTES // (20 * size + 8 * DEGREE))
    return min(most, max(SHARD, int(ROOT * n**0.5)))


def _indexed(shard: int, size: int, vectors: list, ids: list) -> pd.DataFrame:
    held = np.array(vectors, np.float64)
    edges, entry = build_graph(_lifted(held))
    count = np.array([len(x) for x in ids], np.int64)
    row = {"shard": shard, "size": size, "entry": entry, "vectors": held.tobytes(), "edges": edges.astype(np.int32).tobytes(), "counts": count.tobytes(), "ids": np.concatenate(ids).tobytes()}
    return pd.DataFrame([row]).astype({"shard": "int32", "size": "int32", "entry": "int32"})


def _index(nodes: DataFrame, shards: int) -> DataFrame:
    """One row for each shard and dimension: its vectors, ids, edges and entry as bytes."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, vectors, ids = None, [], []
        for frame in frames:
            for shard, size, vector, held in zip(frame["shard"], frame["size"], frame["vector"], frame["ids"]):
                if (shard, size) != key and vectors:
                    yield _indexed(*key, vectors, ids)
                    vectors, ids = [], []
                key = shard, size
                vectors.append(vector)
                ids.append(np.asarray(held, np.int64))
        if vectors:
            yield _indexed(*key, vectors, ids)

    schema = "shard int, size int, entry int, vectors binary, edges binary, counts binary, ids binary"
    dealt = nodes.withColumn("size", F.size("vector")).repartitionById(shards, "shard").sortWithinPartitions("shard", "size", F.col("ids")[0])
    return bound_batches(dealt.select("shard", "size", "vector", "ids")).mapInPandas(each, schema)


class _Shard:
    """One shard with its graph, ready to be searched."""

    def __init__(self, row):
        self.vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, row.size)
        self.edges = np.frombuffer(row.edges, np.int32).reshape(len(self.vectors), -1).astype(np.int64)
        self.ids, self.entry = np.frombuffer(row.ids, np.int64), row.entry
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row.counts, np.int64))])
        self.points = _lifted(self.vectors)
        self.block = max(16, min(QUERY_BLOCK, SEEN_BYTES // len(self.vectors)))

    def search(self, ids: list[int], queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query, id, score) of the k best for each query, its own id left out."""
        unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        aim = np.concatenate([unit, np.zeros((len(unit), 1))], 1).astype(np.float32)
        found, _ = _beam(self.points, self.edges, self.entry, aim, min(len(self.vectors), max(beam, k + 1)))
        for q, query, nodes in zip(ids, queries, found):
            nodes = nodes[nodes >= 0]
            scores = self.vectors[nodes] @ query
            if len(nodes) > k + 1:  # a node has an id at least, and the query is one of them at most
                near = scores >= np.partition(scores, -k - 1)[-k - 1]
                nodes, scores = nodes[near], scores[near]
            hits = [(-s, i) for s, n in zip(scores.tolist(), nodes.tolist()) for i in self.ids[self.starts[n] : self.starts[n + 1]].tolist() if i != q]
            hits.sort()
            for s, i in hits[:k]:
                yield q, i, -s


def _search(index: DataFrame, asked: DataFrame, shards: int, chunks: int, k: int, beam: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every shard for each query. A shard meets a chunk of queries in a task of their own."""
    shard_columns = ["entry", "vectors", "edges", "counts", "ids"]
    at_shard = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    at_query = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    task = (F.col("shard") * chunks + F.col("chunk")).cast("int").alias("task")
    # no null among numbers, for pandas would turn them into floats
    none = {c: F.lit(None).cast(t) for c, t in index.dtypes if c in shard_columns} | {"entry": F.lit(-1)}
    every = at_shard.select(task, "size", *shard_columns, F.lit(0).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector")).unionByName(
        at_query.select(task, "size", *(none[c].alias(c) for c in shard_columns), "id", "vector")
    )

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at, ids, vectors = None, None, [], []

        def ask() -> pd.DataFrame:
            out = list(shard.search(ids, np.array(vectors, np.float64), k, beam)) if shard and ids else []
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.task, row.size) != at:
                    yield ask()
                    shard, at, ids, vectors = None, (row.task, row.size), [], []
                if row.vectors is not None:
                    shard = _Shard(row)
                elif shard is not None:  # else the shard has no vectors of this dimension
                    ids.append(int(row.id))
                    vectors.append(row.vector)
                    if len(ids) >= shard.block:
                        yield ask()
                        ids, vectors = [], []
        yield ask()

    dealt = every.repartitionById(shards * chunks, "task").sortWithinPartitions("task", "size", F.col("vectors").isNull(), "id")
    return bound_batches(dealt).mapInPandas(each, "query_id long, vec_id long, score double")


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard: int | None = None, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of every query's k nearest rows but its own; ties go to the smaller id.

    ``shard``: vectors of a shard on average, instead of what ``shard_size`` gives.
    """
    scratch = Scratch(spark, "ann")
    vectors = scratch.keep(valid_vectors(rows, id_col, vector_col))
    n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    shards = max(1, -(-n // (shard or shard_size(n, size))))
    index = scratch.keep(_index(_nodes(vectors, shards, k + 1), shards))
    asked = scratch.keep(valid_vectors(queries, id_col, vector_col).dropDuplicates(["id"]).withColumn("size", F.size("vector")))
    # enough chunks to bound one, and to give every core a task
    chunks = max(1, -(-asked.count() * 8 * size // CHUNK_BYTES), -(-spark.sparkContext.defaultParallelism // shards))
    hits = scratch.keep(_search(index, asked, shards, chunks, k, beam))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(rows: DataFrame, id_col: str = "vec_id", n: int = EVERY) -> DataFrame:
    """The stated query set: rows whose id is divisible by n."""
    return rows.filter(F.col(id_col) % n == 0)
