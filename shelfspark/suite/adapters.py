"""Views of the test tables in the shapes the operators work on.

Every list of expressions is read by both engines: Spark through ``selectExpr``, DuckDB in
the CTE of the same name. Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEY = "cast(p_partkey AS string)"
_TEXT = "concat(p_brand, ' ', p_name)"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "products": ("part", [
        "p_partkey",
        f"{_KEY} AS product_id",
        f"CASE WHEN p_partkey % 11 <> 0 THEN concat('SKU-', {_KEY}) END AS sku",
        "CASE WHEN p_partkey % 3 = 0 THEN p_name END AS title",
        f"CASE WHEN p_partkey % 3 = 1 OR p_partkey % 6 = 0 THEN {_TEXT} END AS name",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'n/a' "
        "ELSE cast(cast(p_retailprice AS decimal(12,2)) AS string) END AS price",
        "p_brand AS platform",
        f"CASE WHEN p_partkey % 7 <> 0 THEN concat('products-images/', {_KEY}, '.jpg') END AS image_path",
        f"concat({_KEY}, '.json') AS source_file",
    ]),
    "products_padded": ("part", [
        f"{_KEY} AS product_id",
        f"CASE p_partkey % 4 WHEN 0 THEN concat('  ', {_TEXT}, ' ') WHEN 1 THEN concat(chr(9), {_TEXT}, chr(10)) "
        f"WHEN 2 THEN concat({_TEXT}, chr(13), chr(10), ' ') ELSE {_TEXT} END AS name",
        f"CASE WHEN p_partkey % 2 = 0 THEN concat(' SKU-', {_KEY}, ' ') ELSE concat('SKU-', {_KEY}) END AS sku",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 19 = 0 THEN '1e3' "
        "ELSE concat(' ', cast(cast(p_retailprice AS decimal(12,2)) AS string), chr(9)) END AS price",
    ]),
    "checkpoint": ("part", [
        f"CASE WHEN p_size <= 30 THEN concat({_KEY}, '.json') END AS source_file",
        f"CASE WHEN p_size <= 12 THEN concat('products-images/', {_KEY}, '.jpg') END AS image_path",
    ]),
    "identifiers": ("documents", [
        "doc_id",
        "CASE WHEN doc_id % 50 = 0 THEN '' ELSE md5(text) END AS id",
        "CASE WHEN doc_id % 100 = 0 THEN concat('p-', source) END AS product_id",
        "concat('doc-', lpad(cast(doc_id AS string), 12, '0'), '.json') AS source_file",
    ]),
    "detections": ("lineitem", [
        "cast(l_partkey AS string) AS image_id",
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        "cast(round(l_discount * 10, 1) AS double) AS confidence",
        "cast(l_linenumber AS int) AS class_id",
        "cast(l_quantity - 3.5 AS double) AS x1", "cast(l_tax * 100 AS double) AS y1",
        "cast(l_quantity * 2.5 AS double) AS x2", "cast(l_extendedprice / 1000 AS double) AS y2",
    ]),
    "image_products": ("part", [
        f"{_KEY} AS image_id",
        f"{_KEY} AS product_id",
        f"CASE WHEN p_partkey % 11 <> 0 THEN concat('SKU-', {_KEY}) END AS sku",
        f"CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {_TEXT} END AS name",
        "p_name AS title",
        "CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS price",
        "p_brand AS platform",
        f"CASE WHEN p_partkey % 7 <> 0 THEN concat('s3://products/', {_KEY}, '.jpg') END AS image_path",
    ]),
    "payload": ("part", [
        "p_partkey AS point_id",
        f"CASE WHEN p_partkey % 23 <> 0 THEN {_TEXT} END AS name",
        "CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice END AS price",
        f"CASE WHEN p_partkey % 11 <> 0 THEN concat('SKU-', {_KEY}) END AS sku",
        "p_brand AS platform",
    ]),
    "old_products": ("customer", [
        "cast(c_custkey AS string) AS product_id",
        "CASE WHEN c_acctbal < -900 THEN '' ELSE concat(c_mktsegment, '/', 'N', cast(c_nationkey AS string)) END "
        "AS primary_category_path",
        "c_mktsegment", "c_nationkey", "c_acctbal",
    ]),
    "event_rows": ("events", [
        "event_id", "user_id", "event_type", "round(value, 2) AS value", "ts",
        "CASE event_type WHEN 'purchase' THEN 'crawled' WHEN 'view' THEN 'reused' WHEN 'error' THEN 'failed' "
        "WHEN 'click' THEN 'skipped' ELSE 'other' END AS outcome",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def cte(*names: str) -> str:
    """``WITH`` clause defining the named views for DuckDB."""
    parts = []
    for name in names:
        if name in VIEWS:
            source, columns = VIEWS[name]
            parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {source})")
        else:
            parts.append(f"{name} AS ({DERIVED[name]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# Views that are no plain projection: their DuckDB form, with the Spark form below.
DERIVED: dict[str, str] = {
    "image_files": f"""
        SELECT file_name FROM (SELECT unnest([
            CASE WHEN p_size <= 25 THEN concat({_KEY}, '.jpg') END,
            CASE WHEN p_size BETWEEN 10 AND 20 THEN concat({_KEY}, '.jpeg') END,
            CASE WHEN p_size BETWEEN 18 AND 35 THEN concat({_KEY}, '.png') END,
            CASE WHEN p_size > 30 THEN concat({_KEY}, '.JPG') END]) AS file_name FROM part)
        WHERE file_name IS NOT NULL""",
    "query_vectors": """
        SELECT a.vec_id AS query_id, CASE WHEN a.label % 4 = 0
                 THEN list_transform(list_zip(a.embedding, b.embedding, c.embedding),
                        lambda t: ((t[1]::double + t[2]::double + t[3]::double) * 0.5::double)::float)
                 ELSE list_transform(list_zip(a.embedding, b.embedding),
                        lambda t: (0.8::double * t[1]::double + 0.3::double * t[2]::double)::float) END AS vector
        FROM embeddings a
        LEFT JOIN embeddings b ON b.vec_id = a.vec_id // 2
        LEFT JOIN embeddings c ON c.vec_id = a.vec_id // 3""",
    "baskets": """
        SELECT query_id // 20 AS cart_id, query_id, vector FROM query_vectors
        UNION ALL SELECT DISTINCT -1 - label, NULL::bigint, NULL::float[] FROM embeddings""",
    "matches": """
        SELECT query_id, point_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS match_rank
        FROM (SELECT q.query_id, e.vec_id AS point_id,
                     round(list_cosine_similarity(q.vector::double[], e.embedding::double[]), 9) AS score
              FROM query_vectors q, embeddings e)""",
    "items": """
        SELECT query_id // 20 AS cart_id, query_id, m.point_id, score,
               coalesce(name, 'Unknown Product') AS name, coalesce(price, 0.0) AS price,
               price IS NULL AS price_missing, coalesce(sku, '') AS sku, coalesce(platform, '') AS platform
        FROM matches m LEFT JOIN payload USING (point_id) WHERE match_rank = 1 AND score > 0.6""",
    "edges": """
        SELECT concat('R', r_regionkey) AS parent, concat('N', n_nationkey) AS id, false AS is_leaf
        FROM region JOIN nation ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('R', r_regionkey), concat('E', r_regionkey), false FROM region
        UNION ALL SELECT concat('E', r_regionkey), '', true FROM region
        UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), true FROM customer""",
    "pages_ld": """
        SELECT page_id, concat(CASE page_id % 4
            WHEN 0 THEN ''
            WHEN 1 THEN concat('<script type="application/ld+json">', good, '</script>')
            WHEN 2 THEN concat('<script type="application/ld+json">', good, '</script><SCRIPT id="x" type=''application/ld+json''>',
                               chr(10), good, '</SCRIPT>')
            ELSE concat('<script type="application/ld+json">{"broken": </script><script type="application/ld+json">',
                        good, '</script>') END, html) AS html
        FROM (SELECT page_id, html, concat('{"@type":"Product","name":"page ', page_id, '","offers":{"price":', page_id * 2,
                                           '},"sizes":[1,2,3]}') AS good FROM pages)""",
    "rasters": """
        SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, cast(round(
            CASE WHEN vec_id % 10 = 0 THEN 215 + 16 * v::double WHEN vec_id % 2 = 0 THEN 128 + 18 * v::double
                 ELSE 128 + 256 * v::double END) AS bigint)))) AS px FROM embeddings""",
    "pixels": """
        SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS v, px FROM rasters, range(64) t(i)""",
}


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = F.expr(f"""array(
        CASE WHEN p_size <= 25 THEN concat({_KEY}, '.jpg') END,
        CASE WHEN p_size BETWEEN 10 AND 20 THEN concat({_KEY}, '.jpeg') END,
        CASE WHEN p_size BETWEEN 18 AND 35 THEN concat({_KEY}, '.png') END,
        CASE WHEN p_size > 30 THEN concat({_KEY}, '.JPG') END)""")
    return part.select(F.explode(names).alias("file_name")).filter("file_name IS NOT NULL")


def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blends of index vectors: two of them (a clear best match) or three (near the threshold)."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select(F.col("vec_id").alias("_b"), F.col("embedding").alias("b"))
    third = e.select(F.col("vec_id").alias("_c"), F.col("embedding").alias("c"))
    joined = (e.join(other, F.expr("_b = vec_id div 2"), "left").join(third, F.expr("_c = vec_id div 3"), "left"))
    three = F.expr("zip_with(zip_with(embedding, b, (x, y) -> cast(x AS double) + cast(y AS double)), c, "
                   "(s, z) -> cast((s + cast(z AS double)) * 0.5D AS float))")
    two = F.expr("zip_with(embedding, b, (x, y) -> cast(0.8D * cast(x AS double) + 0.3D * cast(y AS double) AS float))")
    return joined.select(F.col("vec_id").alias("query_id"), F.when(F.expr("label % 4 = 0"), three).otherwise(two).alias("vector"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets of twenty detections, and some without any."""
    asked = query_vectors(spark, sf_dir).select(F.expr("query_id div 20").alias("cart_id"), "query_id", "vector")
    empty = table(spark, sf_dir, "embeddings").select((-1 - F.col("label")).cast("bigint").alias("cart_id")).distinct()
    return asked.unionByName(empty, allowMissingColumns=True)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer; per region one node whose only child has no usable id."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        region.join(nation, F.expr("n_regionkey = r_regionkey"))
        .selectExpr("concat('R', r_regionkey) AS parent", "concat('N', n_nationkey) AS id", "false AS is_leaf")
        .unionByName(region.selectExpr("concat('R', r_regionkey) AS parent", "concat('E', r_regionkey) AS id", "false AS is_leaf"))
        .unionByName(region.selectExpr("concat('E', r_regionkey) AS parent", "'' AS id", "true AS is_leaf"))
        .unionByName(customer.selectExpr("concat('N', c_nationkey) AS parent", "concat('C', c_custkey) AS id", "true AS is_leaf")))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) AS root")


def pages_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with none, one, two, or one good and one broken LD-JSON block put in front."""
    good = F.expr("concat('{\"@type\":\"Product\",\"name\":\"page ', page_id, '\",\"offers\":{\"price\":', page_id * 2, "
                  "'},\"sizes\":[1,2,3]}')")
    tag, end = F.lit('<script type="application/ld+json">'), F.lit("</script>")
    kind = F.expr("page_id % 4")
    front = (F.when(kind == 0, F.lit(""))
             .when(kind == 1, F.concat(tag, good, end))
             .when(kind == 2, F.concat(tag, good, end, F.lit("<SCRIPT id=\"x\" type='application/ld+json'>\n"), good,
                                       F.lit("</SCRIPT>")))
             .otherwise(F.concat(tag, F.lit('{"broken": '), end, tag, good, end)))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(front, "html").alias("html"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 gray images."""
    level = F.expr("""transform(embedding, v -> greatest(0, least(255, cast(round(
        CASE WHEN vec_id % 10 = 0 THEN 215 + 16 * cast(v AS double) WHEN vec_id % 2 = 0 THEN 128 + 18 * cast(v AS double)
             ELSE 128 + 256 * cast(v AS double) END) AS bigint))))""")
    data = F.unhex(F.array_join(F.transform(level, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("n_channels"), data.alias("data"), F.concat(F.lit("label-"), "label").alias("platform"))


def pixel_text(data):
    """Raster bytes as text, which both engines can print."""
    return F.lower(F.hex(data))
