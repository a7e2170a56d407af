"""The k-NN join against brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfspark.operators import checkout, neighbours


def frame(spark, vectors, id_col):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{id_col} bigint, vector array<float>").repartition(3)


def brute(queries, points, k, threshold):
    out = []
    for qi, q in enumerate(queries):
        found = []
        for pi, p in enumerate(points):
            a, b = np.asarray(q, np.float32).astype(float), np.asarray(p, np.float32).astype(float)
            if a.size and b.size and a.any() and b.any():
                score = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
                if threshold is None or score > threshold:
                    found.append((-score, pi))
        out += [(qi, pi, r) for r, (_, pi) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.point_id, r.match_rank) for r in df.collect())


def clustered(rng, n, dim, centres):
    base = rng.normal(size=(centres, dim))
    return base[rng.integers(centres, size=n)] + 0.2 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("k,threshold", [(3, 0.6), (1, 0.9), (5, None), (2, 0.995)])
def test_equals_brute_force(spark, k, threshold):
    rng = np.random.default_rng(k)
    points, queries = clustered(rng, 400, 8, 6), clustered(rng, 120, 8, 6)
    for pivots in (1, 7):
        result = neighbours.nearest(frame(spark, queries, "query_id"), frame(spark, points, "point_id"), k, threshold, pivots)
        assert found(result) == brute(queries, points, k, threshold)


def test_copies_and_shards(spark, monkeypatch, tmp_path):
    """A third of index and queries is one vector: its cell is cut in shards and parts, and ties go to the smaller id."""
    for name, rows in (("BLOCK_BYTES", 16), ("SHARD_BYTES", 32), ("PART_BYTES", 24)):
        monkeypatch.setattr(neighbours, name, 4 * 6 * rows)
    rng = np.random.default_rng(1)
    points = np.where((np.arange(300) % 3 == 0)[:, None], [1, 2, 3, 4, 5, 6], rng.normal(size=(300, 6)))
    queries = np.vstack([np.tile([1, 2, 3, 4, 5, 7], (40, 1)), rng.normal(size=(80, 6))])
    index = frame(spark, points, "point_id")
    packed = neighbours.pack_index(index, 5)
    assert packed.cells.shards.max() > 1 and len(packed.cells.occupied) > 1
    asked = frame(spark, queries, "query_id")
    assert found(neighbours.nearest(asked, packed, 4, 0.5)) == brute(queries, points, 4, 0.5)
    neighbours.store_packed(packed, str(tmp_path / "index"))
    stored = neighbours.load_packed(spark, str(tmp_path / "index"))
    assert found(neighbours.nearest(asked, stored, 4, 0.5)) == brute(queries, points, 4, 0.5)


@pytest.mark.parametrize("threshold", [0.6, 0.1, None])
def test_searches_prune_and_do_not_multiply(spark, monkeypatch, threshold):
    """Clustered vectors: a query meets a small share of them, whatever the threshold, and is copied once a shard at most."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4 * 32 * 16)
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 4 * 32 * 64)
    rng = np.random.default_rng(2)
    points = clustered(rng, 600, 32, 12)
    packed = neighbours.pack_index(frame(spark, points, "point_id"), 16)
    asked = frame(spark, points[:60], "query_id")
    seen = neighbours.coverage(asked, packed, 3, threshold)
    assert seen["share"] < 0.3 and seen["copies"] < seen["shards"] / 2 and seen["shards"] < 24
    # By the threshold alone most cells have to be met.
    alone = (packed.cells.gaps(points[:60]) <= np.arccos(0.1 if threshold is None else threshold)) @ packed.cells.counts
    assert seen["share"] < alone.mean() / 600 or threshold == 0.6
    assert found(neighbours.nearest(asked, packed, 3, threshold)) == brute(points[:60], points, 3, threshold)


@pytest.mark.parametrize("threshold", [0.6, None])
def test_cells_of_many_blocks(spark, monkeypatch, threshold):
    """A cell's points in a group are scored some blocks at a time, and each of them is."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4 * 8 * 4)
    rng = np.random.default_rng(4)
    points, queries = clustered(rng, 300, 8, 5), clustered(rng, 30, 8, 5)
    for pivots in (1, 3):
        packed = neighbours.pack_index(frame(spark, points, "point_id"), pivots)
        assert packed.cells.counts.max() > 2 * 4 * packed.cells.rows_in(neighbours.BLOCK_BYTES)
        result = neighbours.nearest(frame(spark, queries, "query_id"), packed, 3, threshold)
        assert found(result) == brute(queries, points, 3, threshold)


def test_small_cells_share_shards_and_large_ones_have_several():
    first, number = neighbours._shards_of(np.array([3, 4, 9, 35, 1, 1, 10, 11]), 10)
    assert first.tolist() == [0, 0, 1, 2, 6, 6, 7, 8] and number.tolist() == [1, 1, 1, 4, 1, 1, 1, 2]


def test_unusable_vectors(spark):
    points = [[1, 0], None, [], [0, 0], [3, 4], [1, 0]]
    queries = [[1, 0], None, [], [0, 0], [2, 0]]
    result = neighbours.nearest(frame(spark, queries, "query_id"), frame(spark, points, "point_id"), 3, 0.6)
    # The cosine of the fifth point is exactly 0.6, hence no match.
    assert found(result) == [(0, 0, 1), (0, 5, 2), (4, 0, 1), (4, 5, 2)]


def test_empty_index_and_mixed_dimensions(spark):
    queries = frame(spark, [[1, 0]], "query_id")
    empty = spark.createDataFrame([], "point_id bigint, vector array<float>")
    assert neighbours.nearest(queries, empty).count() == 0
    mixed = frame(spark, [[1, 0], [1, 0, 0]], "point_id")
    with pytest.raises(Exception, match="dimensions"):
        neighbours.nearest(queries, mixed).collect()
    with pytest.raises(Exception, match="dimensions"):
        neighbours.nearest(frame(spark, [[1, 0, 0]], "query_id"), frame(spark, [[1, 0]], "point_id")).collect()
    with pytest.raises(ValueError, match="dimensions"):
        neighbours.index_dimension(mixed)
    assert neighbours.index_dimension(empty) == 512


def test_no_cross_join_and_no_row_udf(spark):
    rng = np.random.default_rng(3)
    plan = neighbours.nearest(frame(spark, rng.normal(size=(20, 4)), "query_id"), frame(spark, rng.normal(size=(20, 4)), "point_id"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "NestedLoop" not in text and "Cartesian" not in text and "BatchEvalPython" not in text
    assert text.count("WindowGroupLimit") == 2


def test_cart_messages_prices_and_separate_items(spark):
    index = frame(spark, [[1, 0], [0, 1]], "point_id")
    payload = spark.createDataFrame([(0, "A", 2.5, "s", "p"), (1, None, None, None, None)],
                                    "point_id bigint, name string, price double, sku string, platform string")
    asked = spark.createDataFrame([(1, 10, [1.0, 0.1]), (1, 11, [1.0, 0.0]), (2, 12, [0.0, 1.0]), (3, 13, [-1.0, -1.0]), (4, None, None), (5, 14, [])],
                                  "cart_id bigint, query_id bigint, vector array<float>")
    items = checkout.cart_items(asked.filter("query_id IS NOT NULL"), index, payload)
    carts = {r.cart_id: r for r in checkout.carts(asked, items).collect()}
    assert (carts[1].n_items, carts[1].total_price) == (2, 5.0)
    assert (carts[2].n_items, carts[2].total_price, carts[2].n_price_missing) == (1, 0.0, 1)
    assert (carts[3].n_items, carts[3].message) == (0, checkout.MESSAGE_OK)
    assert (carts[4].n_detections, carts[4].message) == (0, checkout.MESSAGE_NONE)
    assert carts[5].message == checkout.MESSAGE_OK
    assert [r.name for r in items.filter("cart_id = 2").collect()] == ["Unknown Product"]
    quantities = checkout.cart_quantities(items).filter("cart_id = 1").first()
    assert (quantities.quantity, quantities.amount) == (2, 5.0)
    page = checkout.cart_pages(items).filter("cart_id = 1").first()
    assert [i.sku for i in page["items"]] == ["s", "s"]


def test_detections_of_one_id_stay_apart(spark):
    """Ids that repeat, within a cart or between two, and ids of another type."""
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "point_id bigint, vector array<float>")
    payload = index.select("point_id", F.lit("n").alias("name"), F.lit(1.0).alias("price"), F.lit("s").alias("sku"), F.lit("p").alias("platform"))
    rows = [(1, 7, [1.0, 0.1]), (2, 7, [0.1, 1.0]), (2, 7, [1.0, 0.0]), (2, 8, None), (3, None, [1.0, 0.0]), (3, 9, [-1.0, -1.0])]
    asked = spark.createDataFrame(rows, "cart_id bigint, query_id bigint, vector array<float>").repartition(3)
    for frame in (asked, checkout.with_search_ids(asked)):
        items = checkout.cart_items(frame, index, payload)
        assert items.columns[:4] == ["query_id", "cart_id", "point_id", "score"] and "search_id" not in items.columns
        assert sorted((r.cart_id, r.query_id, r.point_id) for r in items.collect()) == [(1, 7, 1), (2, 7, 1), (2, 7, 2)]
        assert {r.cart_id: (r.n_detections, r.n_items) for r in checkout.carts(frame, items).collect()} == {1: (1, 1), 2: (3, 2), 3: (1, 0)}
    named = checkout.cart_items(asked.withColumn("query_id", F.concat(F.lit("q"), "query_id")), index, payload)
    assert sorted((r.cart_id, r.query_id) for r in named.collect()) == [(1, "q7"), (2, "q7"), (2, "q7")]


def test_memory_does_not_grow_with_cells_times_queries():
    """A group of many queries holds neither a number for each pair of query and cell nor its vectors in double."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(3)
    dim, n_cells, n = 8, 3000, 20_000
    wide = np.ones((n_cells, 16))
    one = np.ones(n_cells, dtype=np.int64)
    cells = neighbours.Cells(neighbours._unit(rng.normal(size=(250, dim))), 12, np.arange(n_cells), 0 * wide, math.pi * wide, one, 0 * one, one)
    queries, vectors = (rng.normal(size=(m, dim)).astype(np.float32) for m in (n, 40))
    asked = pa.table({"ids": pa.array([np.arange(n)]), "vectors": pa.array([queries.tobytes()], pa.binary()), "reach": pa.array([np.full(n, 4.0)])})
    points = pa.table({"cell": pa.array([5, 2999], pa.int32()), "ids": pa.array([np.arange(25, 40), np.arange(25)]),
                       "vectors": pa.array([vectors[25:].tobytes(), vectors[:25].tobytes()], pa.binary())})
    tracemalloc.start()
    found = neighbours._score(cells, 2, None)(asked, points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.rint(neighbours._unit(queries) @ neighbours._unit(vectors).T * 1e9)
    assert np.array_equal(np.asarray(found["point_id"]).reshape(n, 2), np.argsort(-scores, axis=1, kind="stable")[:, :2])
    assert peak < 64 << 20
    assert max(s.stop - s.start for s in cells.slices(n)) * n_cells * 8 <= 2 * neighbours.GAP_BYTES
