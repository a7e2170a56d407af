"""Nearest neighbours of a query set by a block matrix join with int8 products.

Candidates lie in shards, queries in parts, both of bounded size; every shard meets every part once. In such a tile, vectors are quantised to
int8 with a scale of their own, and products of int8 matrices give approximate distances. By the triangle inequality a true distance
differs from its approximation by at most the sum of the two quantisation errors, which are known. Pairs whose lower bound lies above
the k-th smallest upper bound, or above the k-th distance found so far, are out; for the others the distance is computed from the original vectors in double
precision. Heaps of k keep the nearest of a tile and then of all tiles. The result is exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; only vectors of equal
length are compared; rows repeated in id and vector count once; a query id with several vectors stands for the smallest of them (in array order); a candidate
with the query's id is never its neighbour; equal distances go by smaller id; fewer candidates than k give all of them; empty tables give an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Vector bytes of a shard, queries of a part, and rows and columns of one product.
SHARD_BYTES, PART_QUERIES, TILE = 4 << 20, 1024, (256, 4096)


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


class Quantised:
    """Vectors as int8 with a scale and the length of what rounding lost."""

    def __init__(self, vectors: np.ndarray):
        largest = np.abs(vectors).max(axis=1)
        # Scales of tiny vectors must not vanish.
        self.scale = np.maximum(largest / 127, np.finfo(np.float64).tiny * 2 ** 60)
        self.codes = np.clip(np.rint(vectors / self.scale[:, None]), -127, 127).astype(np.int8)
        kept = self.codes * self.scale[:, None]
        self.norm2 = np.einsum("ij,ij->i", kept, kept)
        lost = vectors - kept
        self.error = np.sqrt(np.einsum("ij,ij->i", lost, lost))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. They are sums below 2^24 up to 1,040 components, so single precision holds them; beyond, double does."""
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, the squares added in the order of the components."""
    total = np.zeros(len(vectors))
    for lost in (vectors - query).T:
        total += lost * lost
    return np.sqrt(total)


def tile_nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query the k nearest (distance, id) among the vectors, in order."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # of (-distance, -id): the worst kept pair is on top
    asked, held = Quantised(queries), Quantised(vectors)
    for left in range(0, len(ids), TILE[1]):
        c = slice(left, left + TILE[1])
        for top in range(0, len(query_ids), TILE[0]):
            q = slice(top, top + TILE[0])
            dots = _products(asked.codes[q], held.codes[c]) * asked.scale[q, None] * held.scale[None, c]
            about = np.sqrt(np.maximum(asked.norm2[q, None] + held.norm2[None, c] - 2 * dots, 0))
            # Rounding of the bounds themselves: the square root magnifies an error of the squares where they cancel.
            slack = 1e-7 * np.sqrt(asked.norm2[q, None] + held.norm2[None, c])
            reach = asked.error[q, None] + held.error[None, c] + slack
            own = query_ids[q, None] == ids[None, c]
            low, high = np.where(own, np.inf, about - reach), np.where(own, np.inf, about + reach)
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(high), np.inf)
            for i, row in enumerate(range(top, min(top + TILE[0], len(query_ids)))):
                heap = heaps[row]
                bound = min(limit[i], -heap[0][0]) if len(heap) == k else limit[i]
                near = np.flatnonzero((low[i] <= bound) & ~own[i])
                exact = distances(vectors[c][near], queries[row])
                near_ids = ids[c][near]
                for j in np.lexsort((near_ids, exact))[:k]:
                    pair = (-float(exact[j]), -int(near_ids[j]))
                    if len(heap) < k:
                        heapq.heappush(heap, pair)
                    elif pair > heap[0]:
                        heapq.heapreplace(heap, pair)
                    else:
                        break
    return [[(-d, -i) for d, i in sorted(heap, reverse=True)] for heap in heaps]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_bytes: int = SHARD_BYTES, part_queries: int = PART_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` for each row of ``queries``, by Euclidean distance."""
    def rows(df: DataFrame) -> DataFrame:
        narrow = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).alias("_vector"))
        return narrow.filter(F.col("_id").isNotNull() & usable("_vector")).withColumn("_size", F.size("_vector"))

    candidates = rows(vectors).dropDuplicates(["_id", "_vector"])
    asked = rows(queries).groupBy("_id").agg(F.min("_vector").alias("_vector")).withColumn("_size", F.size("_vector"))
    components = rows(vectors).agg(F.sum("_size")).first()[0] or 0
    shards = max(1, -(-8 * components // shard_bytes))
    parts = max(1, -(-asked.count() // part_queries))
    shard, part = F.pmod(F.xxhash64("_id", "_vector"), F.lit(shards)), F.pmod(F.xxhash64("_id"), F.lit(parts))
    left = asked.select("*", part.alias("_part"), F.explode(_numbers(shards)).alias("_shard"))
    right = candidates.select("*", shard.alias("_shard"), F.explode(_numbers(parts)).alias("_part"))
    keys = ["_size", "_shard", "_part"]

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(a) and len(b):
            query_ids = a.column("_id").to_numpy()
            found = tile_nearest(query_ids, _matrix(a, "_vector"), b.column("_id").to_numpy(), _matrix(b, "_vector"), k)
            out = [(int(q), i, d) for q, best in zip(query_ids, found, strict=True) for d, i in best]
        q, i, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    gathered = tiles.repartition("query_id").sortWithinPartitions("query_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("query_id", "score", "vec_id")), strict=True))
        out: list[tuple[int, int, int, float]] = []
        for query, run in groupby(pairs, key=lambda r: r[0]):
            best = heapq.nsmallest(k, ((d, i) for _, d, i in run))
            out.extend((query, rank, i, d) for rank, (d, i) in enumerate(best, 1))
            if len(out) > 20_000:
                yield _ranked(out)
                out = []
        yield _ranked(out)

    return gathered.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _ranked(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])
