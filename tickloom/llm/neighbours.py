"""Largest inner products by stable projections: incremental search of a kd-tree with a chi-square stopping test."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import stored


@dataclass(frozen=True)
class Search:
    """``dims`` projected dimensions (even), ``sure``: probability that the stopping test may stop at, ``leaf`` vectors
    per kd-tree leaf, ``shard`` vectors and ``block`` queries that meet in one task."""

    k: int = 20
    dims: int = 8
    sure: float = 0.95
    leaf: int = 128
    shard: int = 4096
    block: int = 20_000
    seed: int = 7


def chi_square_cut(dims: int, sure: float) -> float:
    """x with P(chi-square of ``dims`` degrees <= x) = ``sure``; closed form for even ``dims``, solved by halving."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if below < sure else (low, x)
    return high


def kd_leaves(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers of the leaves of a kd-tree (median cuts of the widest dimension), and their boxes."""
    leaves, waiting = [], [np.arange(len(points))]
    while waiting:
        rows = waiting.pop()
        spread = np.ptp(points[rows], axis=0)
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        halves = np.argpartition(points[rows, int(spread.argmax())], len(rows) // 2)
        waiting += [rows[halves[: len(rows) // 2]], rows[halves[len(rows) // 2 :]]]
    return leaves, np.array([points[r].min(axis=0) for r in leaves]), np.array([points[r].max(axis=0) for r in leaves])


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, longest: float, p: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, inner product) of up to k best per query in one shard.

    Inner products become distances when each vector gets the coordinate sqrt(longest^2 - |x|^2) and each query 0.
    Gaussian (2-stable) projections of those distances are chi-square distributed, so a query visits leaves by rising
    projected distance r and verifies their vectors until r^2 >= cut * d_k^2, d_k being its k-th true distance so far.
    """
    rng = np.random.default_rng(p.seed)
    project = rng.standard_normal((vectors.shape[1] + 1, p.dims))
    lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    leaves, low, high = kd_leaves(np.column_stack([vectors, lift]) @ project, p.leaf)
    asked, size = queries @ project[:-1], (queries**2).sum(axis=1)
    reach = np.zeros((len(queries), len(leaves)))
    for d in range(p.dims):
        reach += np.maximum(0, np.maximum(low[:, d] - asked[:, [d]], asked[:, [d]] - high[:, d])) ** 2
    order = np.argsort(reach, axis=1, kind="stable")
    cut = chi_square_cut(p.dims, p.sure)
    best = np.full((len(queries), p.k), -np.inf)
    found = np.full((len(queries), p.k), np.iinfo(np.int64).max)
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        visited = order[active, step]
        kth = size[active] + longest**2 - 2 * best[active, -1]  # squared distance of the k-th, infinite before there is one
        goes = reach[active, visited] < cut * np.maximum(kth, 0) + 1e-12
        active, visited = active[goes], visited[goes]
        if not len(active):
            break
        by_leaf = np.argsort(visited, kind="stable")
        for part in np.split(by_leaf, np.flatnonzero(np.diff(visited[by_leaf])) + 1):
            who, rows = active[part], leaves[visited[part[0]]]
            rough = queries[who] @ vectors[rows].T
            a, b = np.nonzero((rough >= best[who, -1][:, None] - 1e-9) & (ids[rows][None, :] != query_ids[who][:, None]))
            if len(a):
                merge(best, found, who[a], ids[rows[b]], (queries[who[a]] * vectors[rows[b]]).sum(axis=1), p.k)
    a, b = np.nonzero(found != np.iinfo(np.int64).max)
    return a, found[a, b], best[a, b]


def merge(best: np.ndarray, found: np.ndarray, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Put (id, score) into the k best of query ``who``; equal scores go by smaller id."""
    some = np.unique(who)
    who = np.concatenate([who, np.repeat(some, k)])
    ids, scores = np.concatenate([ids, found[some].ravel()]), np.concatenate([scores, best[some].ravel()])
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    rank = np.arange(len(who)) - np.repeat(np.searchsorted(who, some), np.diff(np.append(np.searchsorted(who, some), len(who))))
    kept = rank < k
    best[who[kept], rank[kept]], found[who[kept], rank[kept]] = scores[kept], ids[kept]


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector as doubles, size) of the rows that take part: an id, and a vector that is neither null, empty nor
    zero and holds no null or non-finite component. An id on several rows counts once, with its smallest vector."""
    plain = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    finite = plain.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sized = finite.withColumn("size", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).filter("size > 0")
    return sized.groupBy("id").agg(F.min(F.struct("vector", "size")).alias("v")).select("id", "v.vector", "v.size")


def nearest(df: DataFrame, queries: str, id: str = "vec_id", vector: str = "embedding", p: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each row for which the SQL condition
    ``queries`` (on ``id``) holds, among all rows but its own; ties go to the smaller id.

    Every usable vector is indexed. Vectors are dealt to shards by a hash of their id, so many equal vectors spread
    evenly; each shard builds its own kd-tree and meets the queries in blocks, and each answer is at most k rows per
    query and shard. Vectors of another length than a query's are not its candidates. Empty tables give no rows.
    """
    held = stored(usable(df, id, vector).withColumn("dims", F.size("vector")), "knn-vectors")
    counts = held.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")).collect()  # one row per vector length
    parts = [search_length(held.filter(F.col("dims") == c["dims"]), queries, c["n"], c["longest"], p) for c in sorted(counts)]
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def search_length(held: DataFrame, condition: str, count: int, longest: float, p: Search) -> DataFrame:
    asked = held.filter(condition)
    shards, blocks = -(-count // p.shard), max(1, -(-asked.count() // p.block))
    vectors = held.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "vector")
    posed = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            rows = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
        else:
            ids, vecs = (left["id"].to_numpy(), matrix(left["vector"]))
            qids, qs = (right["id"].to_numpy(), matrix(right["vector"]))
            who, got, scores = search_shard(ids, vecs, qids, qs, longest * (1 + 1e-12), p)
            rows = [qids[who], got, scores]
        return pa.table(dict(zip(["query_id", "vec_id", "score"], rows, strict=True)))

    return vectors.groupBy("shard", "block").cogroup(posed.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.combine_chunks().flatten()).reshape(len(column), -1)
