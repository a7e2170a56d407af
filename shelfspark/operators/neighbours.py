"""Exact cosine k-nearest-neighbour join.

Vectors are grouped in *cells*: a cell is the nearest of a bounded number of pivot vectors, plus a ring of angles around it. For
each cell the least and greatest angle of its vectors to several pivots is known. Angles obey the triangle inequality, so a match
within some angle of a query lies in a cell only if, for *every* one of those pivots, the query's own angle is within that
reach of the cell's span; a single miss rules the cell out.

A search has two passes. In the first a query meets the cells nearest to it, in one shard; the k-th best score found there bounds how far any of its matches can be.
In the second it meets all cells within that reach (or the threshold's, if that is less). The result is exact, whatever the data.

Small cells share a shard, crowded ones (copies of one vector, say) have several, and the queries of a shard are cut in parts: index and queries meet in a cogroup on
(shard, part) whose two sides are bounded. A query is copied once per shard that holds any of its cells, so never more often than there are shards, and
inside a shard it is multiplied with its cells' blocks only. Each group keeps the top k per query; a ``WindowGroupLimit`` merges the groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.operators.ranking import top_per_group
from shelfspark.session import materialize

SCORE_DECIMALS = 9
#: Packed rows, shards of a cell and parts of its queries, in bytes of float32.
BLOCK_BYTES = 256 * 1024
SHARD_BYTES = 32 * 1024 * 1024
PART_BYTES = 16 * 1024 * 1024
#: What a task holds of the blocks it packs, and of the gaps between queries and cells, in bytes.
HELD_BYTES = 32 * 1024 * 1024
GAP_BYTES = 16 * 1024 * 1024
#: Up to this many index vectors per pivot; an index that needs one pivot is not cut in rings either.
ROWS_PER_PIVOT = 64 * 1024
MAX_PIVOTS = 256
RINGS = 12
#: Pivots (the first of all) to which every cell knows its span of angles.
REFERENCES = 16
_SLACK = 1e-6
_SCALE = 10.0**SCORE_DECIMALS

_PACKED = "cell int, shard int, ids array<bigint>, vectors binary"
_ASKED = "shard int, part int, ids array<bigint>, vectors binary, reach array<double>"
_MATCH = "query_id bigint, point_id bigint, score double"
_KEY = ["shard", "part"]


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors, as a float32 matrix, and their positions."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    filled = lengths > 0
    wrong = filled & (lengths != dim)
    if wrong.any():
        raise ValueError(f"vector of {lengths[wrong][0]} dimensions where {dim} are expected")
    values = column.flatten()
    if values.null_count:
        raise ValueError("vector with a null element")
    positions = np.flatnonzero(filled)
    matrix = np.asarray(values, dtype=np.float32).reshape(len(positions), dim)
    usable = np.square(matrix, dtype=np.float64).sum(axis=1) > 0
    return matrix[usable], positions[usable]


def _unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


@dataclass(frozen=True)
class Cells:
    """Pivots (unit rows), rings around each, and what is known of the occupied cells, in the order of their numbers.

    Cell ``pivot * rings + ring``. ``low`` and ``high`` (cells x references) are the spans of angles, ``counts`` the vectors of a cell,
    ``first`` and ``shards`` the number of its first shard and how many it has. Everything here is bounded by the number of cells.
    """

    pivots: np.ndarray
    rings: int
    occupied: np.ndarray
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    shards: np.ndarray

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]

    def rows_in(self, size: int) -> int:
        return max(1, size // (4 * self.dim))

    def angles(self, matrix: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(matrix) @ self.pivots.T, -1.0, 1.0))

    def cell_of(self, matrix: np.ndarray) -> np.ndarray:
        if self.rings == 1 and len(self.pivots) == 1:
            return np.zeros(len(matrix), np.int32)
        angles = self.angles(matrix)
        nearest = angles.argmin(axis=1)
        ring = (angles[np.arange(len(angles)), nearest] * (self.rings / math.pi)).astype(np.int64)
        return (nearest * self.rings + np.minimum(ring, self.rings - 1)).astype(np.int32)

    def gaps(self, matrix: np.ndarray) -> np.ndarray:
        """(vectors, cells): by how much the angles of a vector to the references miss the spans of a cell, at least; 0 if they may lie in it.

        For few vectors at a time (:meth:`slices`), as it grows with the cells.
        """
        angles = self.reference_angles(matrix)
        out = np.zeros((len(matrix), len(self.occupied)))
        for j in range(self.low.shape[1]):
            np.maximum(out, self.low[None, :, j] - angles[:, j, None], out=out)
            np.maximum(out, angles[:, j, None] - self.high[None, :, j], out=out)
        return out

    def reference_angles(self, matrix: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(matrix) @ self.pivots[:self.low.shape[1]].T, -1.0, 1.0))

    def within(self, angles: np.ndarray, place: int, reach: np.ndarray) -> np.ndarray:
        """Rows of reference angles whose gap to one cell is within their reach."""
        low, high = self.low[place], self.high[place]
        out = np.ones(len(angles), dtype=bool)
        for j in range(len(low)):
            out &= np.maximum(low[j] - angles[:, j], angles[:, j] - high[j]) <= reach
        return np.flatnonzero(out & (reach >= 0))

    def slices(self, n: int) -> Iterator[slice]:
        """Parts of ``n`` vectors whose gaps are held at once."""
        step = max(1024, GAP_BYTES // (8 * max(1, len(self.occupied))))
        return (slice(start, start + step) for start in range(0, n, step))

    def by_shard(self) -> dict[int, list[int]]:
        """Places (in ``occupied``) of the cells that each shard holds, or holds a part of."""
        out: dict[int, list[int]] = {}
        for place, (first, n) in enumerate(zip(self.first.tolist(), self.shards.tolist(), strict=True)):
            for shard in range(first, first + n):
                out.setdefault(shard, []).append(place)
        return out


def _shards_of(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell: neighbours share a shard up to ``limit`` rows, a larger cell has several of its own."""
    first, number, shard, held = [], [], 0, 0
    for n in counts.tolist():
        need = math.ceil(n / limit)
        if need > 1 or held + n > limit:
            shard, held = shard + (held > 0), 0
        first.append(shard)
        number.append(need)
        if need > 1:
            shard += need
        else:
            held += n
    return np.array(first, dtype=np.int64), np.array(number, dtype=np.int64)


def choose_pivots(index: DataFrame, count: int, candidates: int = 1024) -> np.ndarray | None:
    """Up to ``count`` well spread vectors of the index; None for an empty one.

    Pivots decide how much is pruned, never what is found. Their ``candidates`` are the rows with the smallest hashes of
    their ids, whatever the order of the files: a bounded number of rows on the driver. Of these, each next pivot is
    the one farthest from all chosen before.
    """
    usable = index.filter(F.exists("vector", lambda x: x != 0)).select("point_id", "vector")
    rows = sorted(usable.orderBy(F.xxhash64("point_id"), "point_id").limit(candidates if count > 1 else 1).collect(), key=lambda row: row.point_id)
    if not rows:
        return None
    if len({len(row.vector) for row in rows}) > 1:
        raise ValueError("index holds vectors of different dimensions")
    units = _unit(np.array([row.vector for row in rows], dtype=np.float32))
    chosen = [0]
    closest = units @ units[0]
    while len(chosen) < min(count, len(units)):
        farthest = int(closest.argmin())
        if closest[farthest] > 1 - 1e-9:
            break
        chosen.append(farthest)
        closest = np.maximum(closest, units @ units[farthest])
    return units[chosen]


def survey_cells(index: DataFrame, pivots: np.ndarray, rings: int, rows: int) -> Cells:
    """Rows and spans of each cell (at most cells x references rows come back), and the shards that follow.

    A shard stays below ``SHARD_BYTES``; a smaller index is cut so that every core gets some.
    """
    references = min(REFERENCES, len(pivots))
    none = np.zeros(0, dtype=np.int64)
    cells = Cells(pivots, rings, none, np.zeros((0, references)), np.zeros((0, references)), none, none, none)
    cores = index.sparkSession.sparkContext.defaultParallelism
    limit = min(cells.rows_in(SHARD_BYTES), max(cells.rows_in(BLOCK_BYTES), math.ceil(rows / (2 * cores))))
    names = ["cell", "pivot", "n", "low", "high"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            matrix, _ = _matrix(batch.column("vector"), cells.dim)
            if len(matrix):
                angles, own = cells.angles(matrix)[:, :references], cells.cell_of(matrix)
                for cell in np.unique(own).tolist():
                    mine = angles[own == cell]
                    n, low, high = seen.get(cell, (0, np.inf, -np.inf))
                    seen[cell] = [n + len(mine), np.minimum(low, mine.min(axis=0)), np.maximum(high, mine.max(axis=0))]
        found = [(cell, j, n, low[j], high[j]) for cell, (n, low, high) in seen.items() for j in range(references)]
        columns = zip(*found, strict=True) if found else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    spans = index.select("vector").mapInArrow(measure, "cell int, pivot int, n bigint, low double, high double")
    spans = spans.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(tuple(r) for r in spans.collect())
    occupied = np.array([r[0] for r in found[::references]], dtype=np.int64)
    counts = np.array([r[2] for r in found[::references]], dtype=np.int64)
    low, high = (np.array([r[k] for r in found]).reshape(-1, references) for k in (3, 4))
    return Cells(pivots, rings, occupied, low, high, counts, *_shards_of(counts, limit))


def _pack(keys: list[tuple[int, int]], ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([c for c, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()),
        pa.array(ids, pa.list_(pa.int64())), pa.array([v.tobytes() for v in vectors], pa.binary()),
    ], names=["cell", "shard", "ids", "vectors"])


def _pack_points(index: DataFrame, cells: Cells) -> DataFrame:
    """Index vectors in blocks of one cell each; consecutive blocks of a cell go to its shards in turn."""
    block_rows = cells.rows_in(BLOCK_BYTES)
    place = {cell: (first, n) for cell, first, n in zip(cells.occupied.tolist(), cells.first.tolist(), cells.shards.tolist(), strict=True)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}
        most = cells.rows_in(HELD_BYTES)

        def flush(cell: int) -> pa.RecordBatch:
            nonlocal turn
            parts = held.pop(cell)
            del sizes[cell]
            ids = np.concatenate([i for i, _ in parts])
            vectors = np.concatenate([v for _, v in parts])
            starts = range(0, len(ids), block_rows)
            first, shards = place[cell]
            keys = [(cell, first + (turn + i) % shards) for i in range(len(starts))]
            turn += len(starts)
            return _pack(keys, [ids[s:s + block_rows] for s in starts], [vectors[s:s + block_rows] for s in starts])

        for batch in batches:
            matrix, rows = _matrix(batch.column("vector"), cells.dim)
            if not len(rows):
                continue
            ids = np.asarray(batch.column("point_id"))[rows]
            cell_ids = cells.cell_of(matrix)
            for cell in np.unique(cell_ids).tolist():
                mine = cell_ids == cell
                held.setdefault(cell, []).append((ids[mine], matrix[mine]))
                sizes[cell] = sizes.get(cell, 0) + int(mine.sum())
                if sizes[cell] >= block_rows:
                    yield flush(cell)
            while sum(sizes.values()) > most:
                yield flush(max(sizes, key=sizes.__getitem__))
        for cell in list(held):
            yield flush(cell)

    return index.select("point_id", "vector").mapInArrow(pack, _PACKED)


def _reaches(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    return np.asarray(batch.column("reach"), dtype=np.float64)[rows]


def _asked_shards(cells: Cells, home: bool) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Function from query vectors and their reaches to (shard, rows concerned, their reaches in it).

    At ``home`` a query meets only the cells it is nearest to, in one shard: that of the largest among them.
    """
    by_shard = cells.by_shard()

    def route(matrix: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        gaps = cells.gaps(matrix)
        if home:
            own = gaps.min(axis=1)
            largest = np.where(gaps <= own[:, None] + _SLACK, cells.counts[None, :], -1).argmax(axis=1)
            shard = cells.first[largest]
            for one in np.unique(shard).tolist():
                rows = np.flatnonzero(shard == one)
                yield one, rows, own[rows]
            return
        wanted = gaps <= reach[:, None] + _SLACK
        for shard, places in by_shard.items():
            rows = np.flatnonzero(wanted[:, places].any(axis=1))
            if len(rows):
                yield shard, rows, reach[rows]

    return route


def _survey_queries(queries: DataFrame, cells: Cells, home: bool) -> dict[int, int]:
    """Number of queries each shard will be asked by; as many counts as there are shards."""
    route = _asked_shards(cells, home)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, rows = _matrix(batch.column("vector"), cells.dim)
            if len(rows):
                reach = _reaches(batch, rows)
                found = [(shard, len(mine)) for s in cells.slices(len(rows)) for shard, mine, _ in route(matrix[s], reach[s])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], names=["shard", "n"])

    counts = queries.select("vector", "reach").mapInArrow(count, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n"))
    return {row.shard: row.n for row in counts.collect()}


def _pack_queries(queries: DataFrame, cells: Cells, home: bool, parts: dict[int, int]) -> DataFrame:
    """Query vectors in blocks, each in one part of the queries of a shard."""
    route, block_rows = _asked_shards(cells, home), cells.rows_in(BLOCK_BYTES)
    names = ["shard", "part", "ids", "vectors", "reach"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            matrix, rows = _matrix(batch.column("vector"), cells.dim)
            if not len(rows):
                continue
            all_ids, all_reach = np.asarray(batch.column("query_id"))[rows], _reaches(batch, rows)
            for s in cells.slices(len(rows)):
                ids, some = all_ids[s], matrix[s]
                for shard, mine, reach in route(some, all_reach[s]):
                    starts, n_parts = range(0, len(mine), block_rows), parts.get(shard, 1)
                    blocks = [slice(b, b + block_rows) for b in starts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard] * len(blocks), pa.int32()), pa.array([(turn + i) % n_parts for i in range(len(blocks))], pa.int32()),
                        pa.array([ids[mine[b]] for b in blocks], pa.list_(pa.int64())), pa.array([some[mine[b]].tobytes() for b in blocks], pa.binary()),
                        pa.array([reach[b] for b in blocks], pa.list_(pa.float64()))], names=names)
                    turn += len(blocks)

    return queries.select("query_id", "vector", "reach").mapInArrow(pack, _ASKED)


def _lookup(column: str, values: dict[int, int]):
    """The value of a shard, 1 where none is given."""
    wide = {shard: n for shard, n in values.items() if n > 1}
    if not wide:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for pair in wide.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(1))


def _score(cells: Cells, k: int, threshold: float | None):
    dim, block_rows = cells.dim, cells.rows_in(BLOCK_BYTES)

    def gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(table.column("ids").combine_chunks().flatten())
        parts = [np.frombuffer(v.as_buffer(), np.float32) for chunk in table.column("vectors").chunks for v in chunk]
        return ids, np.concatenate(parts).reshape(-1, dim)

    def best(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Top k of every row; ``ids`` ascend, and the first maximum is taken, so ties go to the smaller id."""
        width = min(k, scores.shape[1])
        if width > 16:
            order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
            return np.take_along_axis(scores, order, axis=1), ids[order]
        rows = np.arange(len(scores))
        top_scores, top_ids = np.empty((len(scores), width)), np.empty((len(scores), width), np.int64)
        for place in range(width):
            column = scores.argmax(axis=1)
            top_scores[:, place], top_ids[:, place] = scores[rows, column], ids[column]
            scores[rows, column] = -np.inf
        return top_scores, top_ids

    def score(asked: pa.Table, points: pa.Table) -> pa.Table:
        result = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(asked) and len(points):
            query_ids, queries = gather(asked)
            reach = np.asarray(asked.column("reach").combine_chunks().flatten())
            angles = np.concatenate([cells.reference_angles(queries[q:q + block_rows]) for q in range(0, len(queries), block_rows)])
            top_scores = np.full((len(query_ids), k), -np.inf)
            top_ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)
            blocks = np.asarray(points.column("cell").combine_chunks())
            for cell in np.unique(blocks).tolist():
                own = cells.within(angles, int(np.searchsorted(cells.occupied, cell)), reach + _SLACK)
                if not len(own):
                    continue
                point_ids, vectors = gather(points.filter(pa.array(blocks == cell)))
                order = point_ids.argsort(kind="stable")
                for p in range(0, len(point_ids), 4 * block_rows):
                    some = order[p:p + 4 * block_rows]
                    ids, columns = point_ids[some], _unit(vectors[some]).T
                    for q in range(0, len(own), block_rows):
                        rows = own[q:q + block_rows]
                        found = _unit(queries[rows]) @ columns
                        # Rounded while scaled: copies tie exactly, in whichever block they lie.
                        np.rint(np.multiply(found, _SCALE, out=found), out=found)
                        if threshold is not None:
                            hit = found.max(axis=1) / _SCALE > threshold
                            found, rows = found[hit], rows[hit]
                            if not len(rows):
                                continue
                        new_scores, new_ids = best(found, ids)
                        both = np.hstack([top_scores[rows], new_scores]), np.hstack([top_ids[rows], new_ids])
                        merged = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                        top_scores[rows] = np.take_along_axis(both[0], merged, axis=1)
                        top_ids[rows] = np.take_along_axis(both[1], merged, axis=1)
            top_scores /= _SCALE
            keep = top_scores > (-np.inf if threshold is None else threshold)
            result = [np.repeat(query_ids, k).reshape(-1, k)[keep], top_ids[keep], top_scores[keep]]
        return pa.table(result, names=["query_id", "point_id", "score"])

    return score


@dataclass(frozen=True)
class PackedIndex:
    """An index ready for searching: its cells, and its vectors in blocks ``cell, shard, ids, vectors``."""

    cells: Cells
    blocks: DataFrame
    stored: bool = False


def pack_index(index: DataFrame, pivots: int | None = None) -> PackedIndex | None:
    """Survey an index and plan its blocks; None if it holds no usable vector.

    The number of pivots follows from the number of rows unless it is given.
    """
    rows = index.count()
    count = pivots or min(MAX_PIVOTS, math.ceil(rows / ROWS_PER_PIVOT))
    chosen = choose_pivots(index, max(1, count))
    if chosen is None:
        return None
    cells = survey_cells(index, chosen, 1 if count == 1 else RINGS, rows)
    return PackedIndex(cells, _pack_points(index, cells))


def store_packed(packed: PackedIndex, path: str) -> None:
    """Write a packed index, one folder per cell, so that a search reads the cells it needs and packs nothing."""
    spark, cells = packed.blocks.sparkSession, packed.cells
    pivots = [(i, cells.rings, row.tolist()) for i, row in enumerate(cells.pivots)]
    spark.createDataFrame(pivots, "pivot int, rings int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    known = zip(cells.occupied.tolist(), cells.low.tolist(), cells.high.tolist(), cells.counts.tolist(), cells.first.tolist(), cells.shards.tolist(), strict=True)
    schema = "cell bigint, low array<double>, high array<double>, n bigint, first bigint, shards bigint"
    spark.createDataFrame(list(known), schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    packed.blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")


def load_packed(spark: SparkSession, path: str) -> PackedIndex:
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    columns = [np.array([row[c] for row in known]) for c in ("cell", "low", "high", "n", "first", "shards")]
    cells = Cells(np.array([row.vector for row in pivots]), pivots[0].rings, *columns)
    return PackedIndex(cells, spark.read.schema(_PACKED).parquet(f"{path}/blocks"), stored=True)


def _matches(asked: DataFrame, packed: PackedIndex, k: int, threshold: float | None, home: bool) -> DataFrame:
    """Top k of each (query, shard); ``asked`` is (query_id, vector, reach)."""
    spark, cells = asked.sparkSession, packed.cells
    asked_by = _survey_queries(asked, cells, home)
    parts = {shard: math.ceil(n / cells.rows_in(PART_BYTES)) for shard, n in asked_by.items()}
    blocks = packed.blocks.filter(F.col("shard").isin(list(parts)))
    if packed.stored:  # one folder per cell
        blocks = blocks.filter(F.col("cell").isin(sorted({int(cells.occupied[c]) for shard, places in cells.by_shard().items() if shard in parts for c in places})))
    points = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), _lookup("shard", parts) - 1)))
    # Few bytes make much work here: the partitions follow the number of groups, and are not coalesced.
    n = max(1, min(sum(parts.values()), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    left = _pack_queries(asked, cells, home, parts).repartition(n, *_KEY)
    right = points.select(*_KEY, "cell", "ids", "vectors").repartition(n, *_KEY)
    return left.groupBy(*_KEY).cogroup(right.groupBy(*_KEY)).applyInArrow(_score(cells, k, threshold), _MATCH)


def _angle(score):
    """The angle of a score, a little more than rounding may have taken from it."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), score - 4 / _SCALE)))


def with_reach(queries: DataFrame, packed: PackedIndex, k: int, threshold: float | None) -> DataFrame:
    """(query_id, vector, reach): the angle within which all of a query's k best matches above the threshold lie.

    It is the threshold's, or that of the k-th best score in the cells nearest to the query, if that is less.
    """
    widest = F.lit(math.pi) if threshold is None else _angle(F.lit(float(threshold)))
    asked = queries.select("query_id", "vector", widest.alias("reach"))
    if len(packed.cells.occupied) == 1:
        return asked  # one cell: all meet all of it
    met = top_per_group(_matches(asked, packed, k, None, home=True), ["query_id"], [F.desc("score"), F.col("point_id")], k)
    bounds = met.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, _angle(F.min("score"))).alias("bound"))
    return materialize(asked.join(bounds, "query_id", "left").select("query_id", "vector", F.least("reach", "bound").alias("reach")), "reach")


def coverage(queries: DataFrame, index: PackedIndex, k: int = 3, threshold: float | None = 0.6) -> dict[str, float]:
    """What the second pass of a search does: the share of all pairs it meets, copies of a query, and the number of shards."""
    asked, cells = with_reach(queries, index, k, threshold), index.cells

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = _asked_shards(cells, False)
        for batch in batches:
            matrix, rows = _matrix(batch.column("vector"), cells.dim)
            if len(rows):
                reach = _reaches(batch, rows)
                for s in cells.slices(len(rows)):
                    met = (cells.gaps(matrix[s]) <= reach[s, None] + _SLACK) @ cells.counts
                    copies = sum(len(mine) for _, mine, _ in route(matrix[s], reach[s]))
                    yield pa.RecordBatch.from_arrays([pa.array([len(matrix[s])]), pa.array([int(met.sum())]), pa.array([copies])], names=["n", "met", "copies"])

    total = asked.select("vector", "reach").mapInArrow(measure, "n bigint, met bigint, copies bigint").agg(*[F.sum(c).alias(c) for c in ("n", "met", "copies")]).first()
    return {"share": total.met / (total.n * int(cells.counts.sum())), "copies": total.copies / total.n, "shards": int((cells.first + cells.shards).max())}


def nearest(queries: DataFrame, index: DataFrame | PackedIndex, k: int = 3, threshold: float | None = 0.6,
            pivots: int | None = None) -> DataFrame:
    """Up to ``k`` best points per query with a cosine strictly above ``threshold``.

    ``queries`` has ``query_id bigint, vector array<float>``, ``index`` has ``point_id bigint,
    vector array<float>`` or is packed already; ids are unique. Null, empty and zero vectors
    match nothing; a vector of another dimension is an error. Returns ``query_id, point_id,
    score, match_rank``; scores are rounded to nine decimals, so that copies of a vector tie
    wherever they lie, and ties go to the smaller id.
    """
    packed = index if isinstance(index, PackedIndex) else pack_index(index, pivots)
    if packed is None:
        return queries.sparkSession.createDataFrame([], _MATCH + ", match_rank int")
    matches = _matches(with_reach(queries, packed, k, threshold), packed, k, threshold, home=False)
    return top_per_group(matches, ["query_id"], [F.desc("score"), F.col("point_id")], k, rank_col="match_rank")


def dimensions(vectors: DataFrame, vector: str = "vector", default: int = 512) -> DataFrame:
    """Number of usable vectors and their smallest and largest dimension; ``default`` when there are none."""
    size = F.when(F.size(vector) > 0, F.size(vector))
    return vectors.agg(
        F.count(size).alias("n_vectors"), F.coalesce(F.min(size), F.lit(default)).alias("min_dim"),
        F.coalesce(F.max(size), F.lit(default)).alias("max_dim"))


def index_dimension(vectors: DataFrame, vector: str = "vector", default: int = 512) -> int:
    """The one dimension of a vector table; mixed dimensions are refused."""
    found = dimensions(vectors, vector, default).first()
    if found.min_dim != found.max_dim:
        raise ValueError(f"vectors of {found.min_dim} to {found.max_dim} dimensions in one index")
    return found.min_dim
