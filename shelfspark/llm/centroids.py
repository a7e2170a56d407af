"""Centroid clustering in integers, with bounds that are loosened by the norm of a sum (ns-bounds).

Components become integers, so that sums, centroids and squared distances are exact. For every vector a row of state holds its cluster, an
upper bound of the distance to that centroid and a lower bound for each centroid, each with the round in which the distance was taken.
The centroids of all rounds so far go to the tasks with the job (rounds x clusters x components numbers), and a bound taken in round s is
loosened in round t by the length of the *whole* displacement of its centroid between s and t, which is never more than the sum of the lengths of the
single steps. A vector whose upper bound stays below all other lower bounds keeps its cluster unseen; else its own distance is taken
anew, and then that to every centroid whose bound still fails, in exact integers, ties going to the smaller number.

State is a written table per round (the one before last is deleted). Centroids follow from sums that change by the vectors which moved, added up by
cluster and component before they are shuffled; the driver holds the sums of the clusters only. No vector or cluster is ever gathered in one task.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; zero vectors do; repeated rows stay repeated;
a null id is kept, and comes after all others where the first centroids are chosen (then ties go by the components); fewer vectors than clusters make as many
clusters as there are vectors; an empty table gives an empty table; components of 2^26 or more (behind the scale) fail, for their distances would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.session import materialize, scratch_path

#: Integers below this have squared distances (up to 512 components) that 64 bits hold.
_LARGEST = 1 << 26
#: Bounds are kept apart by this share, far above the rounding of square roots.
_SLACK = 1e-9
_BLOCK = 4096


def usable(vector: str, size: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def integers(vectors: DataFrame, *, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, point): the usable vectors with components floor(scale * x)."""
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v")).filter(usable("_v", size))
    whole = F.transform("_v", lambda x: F.floor(x.cast("double") * scale))
    fits = F.assert_true(F.forall("point", lambda v: (v < _LARGEST) & (v > -_LARGEST)), F.lit(f"a component of {_LARGEST} or more"))
    return narrow.select("id", whole.alias("point")).select("id", F.when(fits.isNull(), F.col("point").cast("array<int>")).alias("point"))


def first_centroids(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The points whose ids have the smallest sha256 of ``seed:id``; ``clusters`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = points.orderBy(key.asc_nulls_last(), "point").limit(clusters).collect()
    return np.array([r.point for r in chosen], dtype=np.int64)


def _points(batch: pa.RecordBatch, column: str = "point") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel(), kind))


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    lost = points - centroid
    return np.einsum("ij,ij->i", lost, lost)


class Bounds:
    """Clusters of a block of points, with bounds that say when they need not be looked at.

    ``lower[i, j]`` is a distance between point i and centroid j as it was in round ``taken[i, j]``; the entry of a point's own cluster is its upper bound
    as well. In the first round nothing is known: ``lower`` is 0 and every distance is taken.
    """

    def __init__(self, points: np.ndarray, cluster: np.ndarray, lower: np.ndarray, taken: np.ndarray):
        self.points, self.cluster, self.lower, self.taken = points, cluster, lower, taken
        self.evaluated = np.zeros(len(points), dtype=np.int64)

    @classmethod
    def unknown(cls, points: np.ndarray, clusters: int) -> Bounds:
        n = len(points)
        return cls(points, np.full(n, -1, dtype=np.int32), np.zeros((n, clusters)), np.zeros((n, clusters), dtype=np.int32))

    def _take(self, rows: np.ndarray, j: int, centroid: np.ndarray, now: int) -> np.ndarray:
        """Exact squared distances of some rows to a centroid; their bounds are those from now on."""
        found = squared(self.points[rows], centroid)
        self.lower[rows, j], self.taken[rows, j] = np.sqrt(found), now
        self.evaluated[rows] += 1
        return found

    def assign(self, history: np.ndarray) -> None:
        """Nearest centroids of the last round of ``history`` (rounds, clusters, components)."""
        now, clusters = len(history) - 1, history.shape[1]
        rows, columns = np.arange(len(self.points)), np.arange(clusters)
        moved = np.sqrt(np.square((history[now] - history).astype(np.float64)).sum(axis=2))  # norm of the whole displacement since each round
        drift = moved[self.taken, columns]
        low = self.lower * (1 - _SLACK) - drift * (1 + _SLACK)
        known = self.cluster >= 0
        own = np.maximum(self.cluster, 0)
        high = np.where(known, (self.lower[rows, own] + drift[rows, own]) * (1 + _SLACK), np.inf)
        low[rows[known], own[known]] = np.inf
        # Own distances are taken anew where the loosened ones do not do, then those that still may be nearer.
        open_rows = np.flatnonzero(low.min(axis=1, initial=np.inf) <= high)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        number = self.cluster.copy()
        for j in range(clusters):
            if len(mine := open_rows[known[open_rows] & (own[open_rows] == j)]):
                best[mine] = self._take(mine, j, history[now, j], now)
                high[mine] = np.sqrt(best[mine]) * (1 + _SLACK)
        for j in range(clusters):
            near = open_rows[low[open_rows, j] <= high[open_rows]]
            if not len(near):
                continue
            found = self._take(near, j, history[now, j], now)
            wins = (found < best[near]) | ((found == best[near]) & (j < number[near]))
            won = near[wins]
            best[won], number[won], high[won] = found[wins], j, np.sqrt(found[wins]) * (1 + _SLACK)
        self.cluster = number


_STATE = "id {kind}, point array<int>, cluster int, was int, lower array<double>, taken array<int>, evaluated long"


def _round(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after the vectors are assigned to the centroids of the last round of ``history``."""
    begun = "cluster" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(start, _BLOCK)
                points = _points(batch)
                if begun:
                    width = history.shape[1]
                    lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()
                    taken = batch.column("taken").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()
                    bounds = Bounds(points, batch.column("cluster").to_numpy().copy(), lower, taken)
                else:
                    bounds = Bounds.unknown(points, history.shape[1])
                was = bounds.cluster
                bounds.assign(history)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), batch.column("point"), pa.array(bounds.cluster), pa.array(was), _lists(bounds.lower, pa.float64()),
                    _lists(bounds.taken, pa.int32()), pa.array(bounds.evaluated)], names=["id", "point", "cluster", "was", "lower", "taken", "evaluated"])

    return state.mapInArrow(run, _STATE.format(kind=state.schema["id"].dataType.simpleString()))


def _changes(state: DataFrame, clusters: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums and counts of the clusters changed: the vectors that moved, added up in the tasks, then by cluster and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, size + 1), dtype=np.int64)
        for batch in filter(len, batches):
            points = np.column_stack([_points(batch), np.ones(batch.num_rows, dtype=np.int64)])
            came, went = batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
            for j in range(clusters):
                total[j] += points[came == j].sum(axis=0) - points[went == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters)), _lists(total, pa.int64())], names=["cluster", "total"])

    moved = state.filter("cluster <> was").select("point", "cluster", "was")
    parts = moved.mapInArrow(run, "cluster long, total array<long>").select("cluster", F.posexplode("total"))
    out = np.zeros((clusters, size + 1), dtype=np.int64)
    for row in parts.groupBy("cluster", "pos").agg(F.sum("col").alias("n")).collect():  # clusters x (components + 1) numbers
        out[row.cluster, row.pos] = row.n
    return out[:, :-1], out[:, -1]


def fit(points: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """State of ``points`` (id, point) after ``rounds`` rounds and a last assignment, and the history of the centroids.

    A round assigns every vector, then replaces each centroid that has vectors by the floor of their mean.
    """
    spark = points.sparkSession
    clusters, size = centroids.shape
    history = centroids[None]
    sums, counts = np.zeros((clusters, size), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
    folder = scratch_path(spark, "centroids")
    state = points
    for turn in range(rounds + 1):
        path = f"{folder}/round={turn}"
        step = _round(state, history)
        step.write.parquet(path)
        state = spark.read.schema(step.schema).parquet(path)
        if turn > 1:
            _delete(spark, f"{folder}/round={turn - 2}")
        if turn < rounds:
            added, more = _changes(state, clusters, size)
            sums, counts = sums + added, counts + more
            means = np.floor_divide(sums, np.maximum(counts, 1)[:, None])
            history = np.concatenate([history, np.where(counts[:, None] > 0, means, history[-1])[None]])
    return state, history


def _delete(spark, path: str) -> None:
    """A table that no frame reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, *, clusters: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector; distances are squared."""
    spark = vectors.sparkSession
    points = materialize(integers(vectors, size=size, scale=scale, id_col=id_col, vector_col=vector_col), "points")
    columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(points, clusters, seed)
    if not len(centroids):
        return points.select(F.col("id").alias(id_col), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")])
    state, history = fit(points, centroids, rounds)
    final = history[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            lost = _points(batch) - final[batch.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", lost, lost))],
                                             names=[id_col, "cluster", "distance"])

    kind = state.schema["id"].dataType.simpleString()
    measured = materialize(state.select("id", "point", "cluster").mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance long"), "clustered")
    found = {r.cluster: int(r.inertia) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    rows = [(j, inertia, sum(found.values()), digest(final[j].tolist())) for j, inertia in sorted(found.items())]  # one row a cluster
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(totals), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
