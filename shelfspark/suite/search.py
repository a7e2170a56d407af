"""Queries over detections, vectors and carts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions import vectors
from shelfspark.operators import checkout, detections as D, neighbours, ranking
from shelfspark.session import materialize, scratch_path
from shelfspark.sinks import model_index
from shelfspark.sinks.vector_index import compact, ensure_index, publish, read_points
from shelfspark.suite.adapters import baskets, cte, index_vectors, query_vectors, table, view

ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "detections").withColumn("bbox", F.array(*[F.col(c).cast("float") for c in ("x1", "y1", "x2", "y2")]))


def confident_detections(spark, sf):
    return D.confident(_detections(spark, sf)).select("image_id", *ORDER, "confidence")


def top1_detection(spark, sf):
    return D.best_per_image(D.confident(_detections(spark, sf)), ORDER).select("image_id", *ORDER, "confidence")


def nearest_centre_detection(spark, sf):
    sized = _detections(spark, sf).withColumns({"width": F.lit(60), "height": F.lit(40)})
    return D.nearest_to_centre(sized, ORDER).select("image_id", *ORDER)


def label_detections(spark, sf):
    numbered = D.number_detections(D.confident(_detections(spark, sf)), ORDER)
    return D.label_detections(numbered, view(spark, sf, "image_products")).select(
        "image_id", *ORDER, F.col("det_idx").cast("bigint").alias("det_idx"), "sub_id", "sku_label")


def object_metadata(spark, sf):
    best = D.best_per_image(D.confident(_detections(spark, sf)), ORDER).withColumn("det_idx", F.lit(0))
    embedded = best.withColumn("embedding", F.transform("bbox", lambda v: v / 2))
    box = D.box_to_int(F.col("bbox"))
    return D.object_metadata(embedded, view(spark, sf, "image_products")).select(
        "sub_id", "point_id", "original_id", "sku", "name", F.round("price", 2).alias("price"), "platform", "image_path",
        "confidence", F.col("embedding_dim").cast("bigint").alias("embedding_dim"),
        *[box[i].cast("bigint").alias(f"box{i}") for i in range(4)])


def crop_boxes(spark, sf):
    box = D.clamp_box(F.col("bbox"), F.lit(100), F.lit(70))
    return _detections(spark, sf).withColumn("box", box).filter("box IS NOT NULL").select(
        "image_id", *ORDER, *[F.col("box")[i].cast("bigint").alias(f"box{i}") for i in range(4)])


def l2_normalize(spark, sf):
    # Scaled first, so that there is something to normalise.
    scaled = F.transform("embedding", lambda v: (v * 4).cast("float"))
    unit = vectors.l2_normalize(F.col("scaled"))
    return table(spark, sf, "embeddings").withColumn("scaled", scaled).withColumn("unit", unit).select(
        "vec_id", F.posexplode("unit").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


def cosine_expression(spark, sf):
    """Similarity of each query to the index vector of the same id, as a column expression."""
    index = index_vectors(spark, sf).select(F.col("point_id").alias("query_id"), F.col("vector").alias("v"))
    return query_vectors(spark, sf).join(index, "query_id").select(
        "query_id", F.round(vectors.cosine(F.col("vector"), F.col("v")), 6).alias("score"))


def cosine_topk(spark, sf):
    found = neighbours.nearest(query_vectors(spark, sf), index_vectors(spark, sf), k=3, threshold=None)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("match_rank").cast("bigint").alias("match_rank"))


def cosine_threshold(spark, sf):
    found = neighbours.nearest(query_vectors(spark, sf), index_vectors(spark, sf), k=3, threshold=0.6)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"))


def self_neighbours(spark, sf):
    """The three nearest other vectors of every vector."""
    index = index_vectors(spark, sf)
    found = neighbours.nearest(index.withColumnRenamed("point_id", "query_id"), index, k=4, threshold=None)
    others = found.filter("query_id <> point_id").drop("match_rank")
    return ranking.top_per_group(others, ["query_id"], [F.desc("score"), F.col("point_id")], 3).withColumn("score", F.round("score", 6))


PIVOTS = 24


def cosine_topk_cells(spark, sf):
    """As ``cosine_topk``, through cells and the two passes."""
    found = neighbours.nearest(query_vectors(spark, sf), index_vectors(spark, sf), k=3, threshold=None, pivots=PIVOTS)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("match_rank").cast("bigint").alias("match_rank"))


def cosine_threshold_cells(spark, sf):
    """As ``cosine_threshold``, through the cells of a stored index."""
    path = scratch_path(spark, "packed")
    neighbours.store_packed(neighbours.pack_index(index_vectors(spark, sf), PIVOTS), path)
    found = neighbours.nearest(query_vectors(spark, sf), neighbours.load_packed(spark, path), k=3, threshold=0.6)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"))


def self_neighbours_cells(spark, sf):
    """As ``self_neighbours``, through cells."""
    index = index_vectors(spark, sf)
    found = neighbours.nearest(index.withColumnRenamed("point_id", "query_id"), index, k=4, threshold=None, pivots=PIVOTS)
    others = found.filter("query_id <> point_id").drop("match_rank")
    return ranking.top_per_group(others, ["query_id"], [F.desc("score"), F.col("point_id")], 3).withColumn("score", F.round("score", 6))


def _items(spark, sf):
    # Stored once, as the vectors of a real run would be.
    asked = checkout.with_search_ids(baskets(spark, sf), "baskets")
    return asked, checkout.cart_items(asked, index_vectors(spark, sf), view(spark, sf, "payload"))


def cart_checkout(spark, sf):
    asked, items = _items(spark, sf)
    return checkout.carts(asked, items).select(
        "cart_id", "n_detections", "n_items", F.round("total_price", 2).alias("total_price"), "n_price_missing", "message")


def cart_items(spark, sf):
    return _items(spark, sf)[1].select("cart_id", "query_id", "point_id", F.round("score", 6).alias("score"), "name",
                                       F.round("price", 2).alias("price"), "price_missing", "sku", "platform")


def cart_lines(spark, sf):
    return checkout.cart_lines(_items(spark, sf)[1])


def cart_quantities(spark, sf):
    return checkout.cart_quantities(_items(spark, sf)[1]).select(
        "cart_id", "point_id", "name", "sku", "platform", "quantity", F.round("amount", 2).alias("amount"))


def cart_reply_pages(spark, sf):
    items = materialize(_items(spark, sf)[1], "items")
    pages = checkout.cart_pages(items, page_size=8)
    return pages.select("cart_id", "page", F.size("items").cast("bigint").alias("n_items"),
                        F.concat_ws("|", F.transform("items", lambda i: i["name"])).alias("names"))


def match_payload(spark, sf):
    """All matches above the lower threshold with their reply columns."""
    found = neighbours.nearest(query_vectors(spark, sf), index_vectors(spark, sf), k=3, threshold=0.1)
    return checkout.describe_matches(found.drop("match_rank"), view(spark, sf, "payload")).select(
        "query_id", "point_id", F.round("score", 6).alias("score"), "name", F.round("price", 2).alias("price"), "price_missing", "sku", "platform")


def cart_missing_payload(spark, sf):
    """Matches some of whose points have no payload row."""
    found = neighbours.nearest(query_vectors(spark, sf), index_vectors(spark, sf), k=3, threshold=0.1)
    return checkout.describe_matches(found.drop("match_rank"), view(spark, sf, "payload").filter("point_id % 3 <> 0")).select(
        "query_id", "point_id", "name", F.round("price", 2).alias("price"), "price_missing", "sku", "platform")


def index_dimensions(spark, sf):
    found = neighbours.dimensions(table(spark, sf, "embeddings"), "embedding")
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


def _objects(spark, sf):
    """Published objects; some with an empty vector."""
    payload = view(spark, sf, "payload")
    vectors_ = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.col("label") == 3, F.array().cast("array<float>")).otherwise(F.col("embedding")))
    return (vectors_.join(payload, F.col("vec_id") == F.col("point_id")).drop("point_id")
            .withColumn("sub_id", F.concat(F.col("vec_id").cast("string"), F.lit("_obj0"))))


def point_payload(spark, sf):
    points = D.points(_objects(spark, sf).select("sub_id", "name", "sku", F.round("price", 2).alias("price"), "embedding"))
    return points.select("point_id", F.size("vector").cast("bigint").alias("dim"), "payload.*")


def vector_upsert(spark, sf):
    """An index published in two batches, the second one replayed; later payloads win."""
    path = scratch_path(spark, "index")
    objects = _objects(spark, sf).select("sub_id", "label", "embedding", F.lit("first").alias("version"))
    ensure_index(spark, path, "objects", 64)
    publish(D.points(objects), path, 0)
    later = D.points(objects.filter("label >= 5").withColumn("version", F.lit("second")))
    for _ in range(2):
        ensure_index(spark, path, "objects", 64)
        publish(later, path, 1)
    return read_points(spark, path).select("point_id", "payload.sub_id", "payload.version", F.round(F.col("vector")[0].cast("double"), 6).alias("v0"))


def index_compaction(spark, sf):
    """Three batches, folded into the base behind the second and again behind the third; the second one is published again in between."""
    path = scratch_path(spark, "index")
    objects = _objects(spark, sf).select("sub_id", "label", "embedding")
    ensure_index(spark, path, "objects", 64)
    for batch, condition in enumerate(("label < 7", "label % 2 = 0", "label >= 6")):
        points = D.points(objects.filter(condition).withColumn("batch", F.lit(batch)))
        publish(points, path, batch)
        if batch:
            compact(spark, path)
        if batch == 1:
            publish(points, path, batch)
    return read_points(spark, path).select("point_id", "payload.sub_id", F.col("payload.batch").cast("bigint").alias("from_batch"),
                                           F.round(F.col("vector")[0].cast("double"), 6).alias("v0"))


def _narrowed(vectors_: DataFrame) -> DataFrame:
    """Vectors of a stand-in second model: half the dimensions."""
    return vectors_.withColumn("vector", F.slice("vector", 1, 32)).withColumn("model", F.lit("narrow"))


def _both_models(vectors_: DataFrame) -> DataFrame:
    return vectors_.withColumn("model", F.lit("wide")).unionByName(_narrowed(vectors_))


def _model_points(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label")
    payload = F.struct(F.concat(F.col("point_id").cast("string"), F.lit("_obj0")).alias("sub_id"))
    return index_vectors(spark, sf).join(labels, "point_id").withColumn("payload", payload)


def _model_index(spark, sf):
    """An index amid a change of the model: the new one has embedded the points of the lower labels."""
    path = scratch_path(spark, "models")
    model_index.register(spark, path, "wide", 64)
    model_index.register(spark, path, "narrow", 32)
    model_index.publish(_both_models(_model_points(spark, sf)).filter("model = 'wide' OR label < 5"), path, 0)
    return path


def model_status(spark, sf):
    return model_index.status(spark, _model_index(spark, sf)).withColumn("dim", F.col("dim").cast("bigint"))


def model_backlog(spark, sf):
    return model_index.backlog(spark, _model_index(spark, sf), "narrow")


def model_search(spark, sf):
    """Queries of both models, after the new one has caught up with its backlog; the second batch is published twice."""
    path = _model_index(spark, sf)
    missing = materialize(model_index.backlog(spark, path, "narrow"), "backlog").select("point_id")
    for _ in range(2):
        model_index.publish(_narrowed(_model_points(spark, sf).join(missing, "point_id")), path, 1)
    found = model_index.nearest(_both_models(query_vectors(spark, sf)), path, k=3, threshold=None)
    return found.select("model", "query_id", "point_id", F.round("score", 6).alias("score"), F.col("match_rank").cast("bigint").alias("match_rank"))


def model_fallback(spark, sf):
    """Matches of the new model where it has any, else of the old one; packed versions of both are searched."""
    path = _model_index(spark, sf)
    model_index.publish_packed(spark, path)
    found = model_index.nearest(_both_models(query_vectors(spark, sf)), path, k=3, threshold=0.6, packed=True)
    return model_index.preferred(found, ["narrow", "wide"]).select(
        "model", "query_id", "point_id", F.round("score", 6).alias("score"), F.col("match_rank").cast("bigint").alias("match_rank"))


QUERIES = {f.__name__: f for f in (
    confident_detections, top1_detection, nearest_centre_detection, label_detections, object_metadata, crop_boxes,
    l2_normalize, cosine_expression, cosine_topk, cosine_threshold, self_neighbours, cosine_topk_cells, cosine_threshold_cells,
    self_neighbours_cells, cart_checkout, cart_items, cart_lines,
    cart_quantities, cart_reply_pages, match_payload, cart_missing_payload, index_dimensions, point_payload, vector_upsert, index_compaction,
    model_status, model_backlog, model_search, model_fallback)}

_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice"
_BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, {_ORDER}) AS rn
    FROM detections WHERE confidence >= 0.5) WHERE rn = 1)"""
_VECTORS = ("query_vectors", "matches")
_CART = ("query_vectors", "matches", "payload", "items", "baskets")
_HASH = "(('0x' || substr(md5({}), 1, 16))::ubigint % 9223372036854775808)::bigint"


def _box(i: int, column: str) -> str:
    return f"cast(trunc({column}::float) AS bigint) AS box{i}"


_NARROW = """, narrow AS (SELECT query_id, point_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS match_rank,
        row_number() OVER (PARTITION BY query_id, coalesce(label < 5, false) ORDER BY score DESC, point_id) AS rank_so_far FROM (
        SELECT q.query_id, e.vec_id AS point_id, label, round(list_cosine_similarity(q.vector[1:32]::double[], e.embedding[1:32]::double[]), 9) AS score
        FROM query_vectors q, embeddings e))"""

ORACLE = {
    "confident_detections": cte("detections") + f"SELECT image_id, {_ORDER}, confidence FROM detections WHERE confidence >= 0.5",
    "top1_detection": cte("detections") + f", {_BEST} SELECT image_id, {_ORDER}, confidence FROM best",
    "nearest_centre_detection": cte("detections") + f"""SELECT image_id, {_ORDER} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY
        ((x1::float + x2::float)::double / 2 - 30) * ((x1::float + x2::float)::double / 2 - 30)
        + ((y1::float + y2::float)::double / 2 - 20) * ((y1::float + y2::float)::double / 2 - 20), {_ORDER}) AS rn FROM detections) WHERE rn = 1""",
    "label_detections": cte("detections", "image_products") + f"""SELECT image_id, {_ORDER}, det_idx, product_id || '_obj' || det_idx AS sub_id, coalesce(sku, product_id) AS sku_label
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_ORDER}) - 1 AS det_idx FROM detections WHERE confidence >= 0.5)
        JOIN image_products USING (image_id)""",
    "object_metadata": cte("detections", "image_products") + f""", {_BEST} SELECT product_id || '_obj0' AS sub_id, {_HASH.format("product_id || '_obj0'")} AS point_id,
        product_id AS original_id, coalesce(sku, product_id) AS sku, coalesce(nullif(name, ''), title, '') AS name, round(price, 2) AS price, platform,
        coalesce(image_path, '') AS image_path, confidence, 4::bigint AS embedding_dim,
        {_box(0, 'x1')}, {_box(1, 'y1')}, {_box(2, 'x2')}, {_box(3, 'y2')} FROM best JOIN image_products USING (image_id)""",
    "crop_boxes": cte("detections") + f"""SELECT * FROM (SELECT image_id, {_ORDER},
        least(greatest(cast(trunc(x1::float) AS bigint), 0), 100) AS box0, least(greatest(cast(trunc(y1::float) AS bigint), 0), 70) AS box1,
        least(greatest(cast(trunc(x2::float) AS bigint), 0), 100) AS box2, least(greatest(cast(trunc(y2::float) AS bigint), 0), 70) AS box3 FROM detections)
        WHERE box2 > box0 AND box3 > box1""",
    "l2_normalize": """SELECT vec_id, i, round(s[i + 1]::double / sqrt(list_sum(list_transform(s, lambda v: v::double * v::double))), 6) AS v
        FROM (SELECT vec_id, list_transform(embedding, lambda v: (v * 4)::float) AS s FROM embeddings), range(64) t(i)""",
    "cosine_expression": cte("query_vectors") + """SELECT query_id, round(list_cosine_similarity(vector::double[], embedding::double[]), 6) AS score
        FROM query_vectors JOIN embeddings ON vec_id = query_id""",
    "cosine_topk": cte(*_VECTORS) + "SELECT query_id, point_id, round(score, 6) AS score, match_rank FROM matches WHERE match_rank <= 3",
    "cosine_threshold": cte(*_VECTORS) + "SELECT query_id, point_id, round(score, 6) AS score FROM matches WHERE match_rank <= 3 AND score > 0.6",
    "self_neighbours": """SELECT query_id, point_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rn
        FROM (SELECT a.vec_id AS query_id, b.vec_id AS point_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) AS score
              FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rn <= 3""",
    "cart_checkout": cte(*_CART) + """SELECT b.cart_id, n_detections, coalesce(n_items, 0) AS n_items, coalesce(total_price, 0.0) AS total_price,
        coalesce(n_price_missing, 0) AS n_price_missing,
        CASE WHEN n_detections > 0 THEN 'Thành công' ELSE 'Không tìm thấy sản phẩm nào trong ảnh' END AS message
        FROM (SELECT cart_id, count(query_id) AS n_detections FROM baskets GROUP BY cart_id) b
        LEFT JOIN (SELECT cart_id, count(*) AS n_items, round(sum(price), 2) AS total_price, count(*) FILTER (price_missing) AS n_price_missing
                   FROM items GROUP BY cart_id) i ON i.cart_id = b.cart_id""",
    "cart_items": cte(*_CART) + """SELECT cart_id, query_id, point_id, round(score, 6) AS score, name, round(price, 2) AS price, price_missing, sku, platform FROM items""",
    "cart_lines": cte(*_CART) + """SELECT cart_id, query_id, name, printf('$%.2f', price) AS price_text, 'SKU: ' || coalesce(nullif(sku, ''), 'N/A') AS sku_text FROM items""",
    "cart_quantities": cte(*_CART) + """SELECT cart_id, point_id, name, sku, platform, count(*) AS quantity, round(sum(price), 2) AS amount
        FROM items GROUP BY ALL""",
    "cart_reply_pages": cte(*_CART) + """SELECT cart_id, page, count(*) AS n_items, string_agg(name, '|' ORDER BY query_id) AS names FROM (
        SELECT *, (row_number() OVER (PARTITION BY cart_id ORDER BY query_id) + 7) // 8 AS page FROM items) GROUP BY cart_id, page""",
    "match_payload": cte("query_vectors", "matches", "payload") + """SELECT query_id, point_id, round(score, 6) AS score, coalesce(name, 'Unknown Product') AS name,
        round(coalesce(price, 0.0), 2) AS price, price IS NULL AS price_missing, coalesce(sku, '') AS sku, coalesce(platform, '') AS platform
        FROM matches LEFT JOIN payload USING (point_id) WHERE match_rank <= 3 AND score > 0.1""",
    "cart_missing_payload": cte("query_vectors", "matches", "payload") + """SELECT query_id, m.point_id, coalesce(name, 'Unknown Product') AS name,
        round(coalesce(price, 0.0), 2) AS price, price IS NULL AS price_missing, coalesce(sku, '') AS sku, coalesce(platform, '') AS platform
        FROM matches m LEFT JOIN (SELECT * FROM payload WHERE point_id % 3 <> 0) p ON p.point_id = m.point_id WHERE match_rank <= 3 AND score > 0.1""",
    "index_dimensions": "SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings",
    "point_payload": cte("payload") + f"""SELECT {_HASH.format("vec_id || '_obj0'")} AS point_id, 64::bigint AS dim, vec_id || '_obj0' AS sub_id, name, sku, round(price, 2) AS price
        FROM embeddings JOIN payload ON point_id = vec_id WHERE label <> 3""",
    "index_compaction": f"""SELECT {_HASH.format("vec_id || '_obj0'")} AS point_id, vec_id || '_obj0' AS sub_id,
        CASE WHEN label >= 6 THEN 2 WHEN label % 2 = 0 THEN 1 ELSE 0 END::bigint AS from_batch, round(embedding[1]::double, 6) AS v0
        FROM embeddings WHERE label <> 3 AND vec_id IN (SELECT p_partkey FROM part)""",
    "vector_upsert": f"""SELECT {_HASH.format("vec_id || '_obj0'")} AS point_id, vec_id || '_obj0' AS sub_id,
        CASE WHEN label >= 5 THEN 'second' ELSE 'first' END AS version, round(embedding[1]::double, 6) AS v0
        FROM embeddings WHERE label <> 3 AND vec_id IN (SELECT p_partkey FROM part)""",
    "model_status": """SELECT 'wide' AS model, 64::bigint AS dim, count(*) AS n_points, 0::bigint AS n_missing FROM embeddings
        UNION ALL SELECT 'narrow', 32, count(*) FILTER (label < 5), count(*) - count(*) FILTER (label < 5) FROM embeddings""",
    "model_backlog": "SELECT vec_id AS point_id, vec_id || '_obj0' AS sub_id FROM embeddings WHERE (label < 5) IS NOT true",
    "model_search": cte(*_VECTORS) + _NARROW + """SELECT 'wide' AS model, query_id, point_id, round(score, 6) AS score, match_rank FROM matches WHERE match_rank <= 3
        UNION ALL SELECT 'narrow', query_id, point_id, round(score, 6), match_rank FROM narrow WHERE match_rank <= 3""",
    "model_fallback": cte(*_VECTORS) + _NARROW + """, renewed AS (SELECT * FROM narrow WHERE label < 5 AND rank_so_far <= 3 AND score > 0.6)
        SELECT 'narrow' AS model, query_id, point_id, round(score, 6) AS score, rank_so_far AS match_rank FROM renewed
        UNION ALL SELECT 'wide', query_id, point_id, round(score, 6), match_rank FROM matches
        WHERE match_rank <= 3 AND score > 0.6 AND query_id NOT IN (SELECT query_id FROM renewed)""",
}
ORACLE |= {f"{name}_cells": ORACLE[name] for name in ("cosine_topk", "cosine_threshold", "self_neighbours")}
