"""Queries over rasters, with stand-in models where one is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.operators import images as I, inference
from shelfspark.plans.indexing import build_index
from shelfspark.plans.preprocessing import run_stages
from shelfspark.session import scratch_path
from shelfspark.sinks.vector_index import read_points
from shelfspark.suite.adapters import cte, pixel_text, rasters, table, view


def image_quality(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_quality(rasters(spark, sf)).select(
        "vec_id", F.round("laplacian_var", 6).alias("laplacian_var"), F.round("brightness", 6).alias("brightness"), "is_blurred", "is_glare")


def image_quality_report(spark, sf):
    return I.quality_report(I.with_quality(rasters(spark, sf))).select("platform", "n_images", "n_blurred", "n_glare", "n_unreadable")


def image_sharpen(spark, sf):
    return I.sharpen(rasters(spark, sf)).select("vec_id", pixel_text(F.col("data")).alias("pixels"), "state")


def image_median(spark, sf):
    return I.median(rasters(spark, sf)).select("vec_id", pixel_text(F.col("data")).alias("pixels"), "state")


def image_clean_states(spark, sf):
    """The cleaning job over good, empty, undecodable and damaged rasters."""
    damaged = rasters(spark, sf).withColumns({
        "data": F.when(F.col("platform") == "label-1", F.lit(None).cast("binary")).when(F.col("platform") == "label-2", F.unhex(F.lit("0102"))).otherwise(F.col("data")),
        "height": F.when(F.col("platform") == "label-3", -1).otherwise(F.col("height"))})
    return I.clean_images(damaged).groupBy("platform", "cleaning_state").agg(F.count(F.lit(1)).alias("n"))


def fit_sizes(spark, sf):
    sized = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).alias("width"), (F.lit(2000) - F.col("p_size") * 30).alias("height"))
    return I.target_size(sized).select("p_partkey", F.col("target_width").cast("bigint").alias("target_width"), F.col("target_height").cast("bigint").alias("target_height"))


def normalize_image(spark, sf):
    """Halved 8x8 images: every target pixel is the average of four."""
    out = I.normalize_images(rasters(spark, sf), limit=4)
    return out.select("vec_id", F.col("height").cast("bigint").alias("height"), F.col("width").cast("bigint").alias("width"), pixel_text(F.col("data")).alias("pixels"), "state")


def whiten_background(spark, sf):
    """Foreground: the left half of each image."""
    masked = rasters(spark, sf).withColumn("foreground", F.unhex(F.lit("0101010100000000" * 8)))
    return I.whiten_background(masked).select("vec_id", pixel_text(F.col("data")).alias("pixels"), "transform_state")


def crop_objects(spark, sf):
    """One box per image, masked for every second one; the mask is given at half size."""
    boxes = rasters(spark, sf).select(
        "image_id", "vec_id", F.array(*[F.lit(v).cast("float") for v in (-2.5, 2.0, 5.9, 11.0)]).alias("bbox"),
        F.when(F.col("vec_id") % 2 == 0, F.unhex(F.lit("01010000" * 4))).alias("mask"), F.lit(4).alias("mask_height"), F.lit(4).alias("mask_width"))
    return I.crop_objects(rasters(spark, sf), boxes).select(
        "vec_id", F.col("height").cast("bigint").alias("height"), F.col("width").cast("bigint").alias("width"), "mask_applied", pixel_text(F.col("data")).alias("pixels"))


def _bright_regions():
    """Stand-in detector: the box of the pixels above 128, and the whole image with less confidence."""
    def find(image: np.ndarray) -> list[dict]:
        rows, columns = np.nonzero(image[:, :, 0] > 128)
        if not len(rows):
            return []
        box = [columns.min(), rows.min(), columns.max() + 1, rows.max() + 1]
        return [{"bbox": [0, 0, image.shape[1], image.shape[0]], "confidence": 0.5, "class_id": 1},
                {"bbox": box, "confidence": 0.75, "class_id": 0}, {"bbox": box, "confidence": 0.25, "class_id": 2}]
    return lambda images: [find(image) for image in images]


def _means():
    """Stand-in embedder: means of the four quarters."""
    def embed(image: np.ndarray) -> list[float]:
        h, w = image.shape[0] // 2, image.shape[1] // 2
        return [float(part.mean()) for part in (image[:h, :w], image[:h, w:], image[h:, :w], image[h:, w:])]
    return lambda images: [embed(image) for image in images]


def model_detections(spark, sf):
    found = inference.detect(rasters(spark, sf), _bright_regions, keep=("vec_id",))
    return found.select("vec_id", F.col("det_idx").cast("bigint").alias("det_idx"), F.col("confidence").cast("double").alias("confidence"),
                        F.col("class_id").cast("bigint").alias("class_id"), *[F.col("bbox")[i].cast("double").alias(f"b{i}") for i in range(4)])


def _with_products(spark, sf):
    products = view(spark, sf, "image_products")
    return rasters(spark, sf).drop("platform").join(products, "image_id")


def object_records(spark, sf):
    found = inference.object_records(_with_products(spark, sf), _bright_regions, _means)
    return found.select("sub_id", "sku", "name", "object_path", "mask_applied", F.col("embedding_dim").cast("bigint").alias("embedding_dim"),
                        F.col("confidence").cast("double").alias("confidence"))


def labelled_objects(spark, sf):
    found = inference.label(rasters(spark, sf).drop("platform"), _bright_regions, view(spark, sf, "image_products"))
    return found.select("sub_id", "sku_label", F.col("confidence").cast("double").alias("confidence"), F.octet_length("crop_data").cast("bigint").alias("n_bytes"))


def index_job(spark, sf):
    """From all rasters and their products to published points: the vectors of the best objects, as they are read back."""
    out = scratch_path(spark, "index-job")
    build_index(_with_products(spark, sf), _bright_regions, _means, out, "objects", "r1", 0)
    points = read_points(spark, f"{out}/index/objects")
    return points.select("payload.sub_id", "payload.sku", "payload.name", *[F.round(F.col("vector")[k].cast("double"), 6).alias(f"v{k}") for k in range(4)])


def _tagged_files() -> I.Codec:
    """Stand-in file format: a tag before the pixels of 8x8 gray images. It refuses what is brighter than 200 on average."""
    def encode(image: np.ndarray) -> bytes:
        if image.mean() > 200:
            raise ValueError("too bright")
        return b"GRAY" + image.tobytes()

    def decode(data: bytes) -> np.ndarray:
        if data[:4] != b"GRAY":
            raise ValueError("no such file")
        return np.frombuffer(data, np.uint8, offset=4).reshape(8, 8, 1)
    return I.Codec(encode, decode)


def _staged(spark, sf):
    stored = rasters(spark, sf).withColumn("path", F.concat(F.lit("s3://products/"), "image_id", F.lit(".jpg")))

    def left_half(df: DataFrame) -> DataFrame:
        return df.withColumn("foreground", F.unhex(F.lit("0101010100000000" * 8)))

    return run_stages(view(spark, sf, "image_products"), stored, left_half, scratch_path(spark, "stages"), "r1", codec=_tagged_files())


def preprocessing_job(spark, sf):
    """All stages over the products and their images, as files of a stand-in format that not every image fits."""
    return _staged(spark, sf).last.select(
        "product_id", "sku", "name", F.round("price", 2).alias("price"), "pipeline_state.*", "clean_path", "transform_path", "is_encoded", pixel_text(F.col("data")).alias("file"))


def preprocessing_clean_files(spark, sf):
    """What the cleaning stage of the same job has stored."""
    stored = spark.read.parquet(_staged(spark, sf).frames["clean"])
    return stored.select("product_id", "cleaning_state", "is_encoded", pixel_text(F.col("data")).alias("file"))


QUERIES = {f.__name__: f for f in (
    image_quality, image_quality_report, image_sharpen, image_median, image_clean_states, fit_sizes, normalize_image,
    whiten_background, crop_objects, model_detections, object_records, labelled_objects, index_job,
    preprocessing_job, preprocessing_clean_files)}


def _at(dy: int, dx: int, border: str) -> str:
    """Pixel at an offset; ``reflect`` leaves the edge pixel out, ``edge`` repeats it."""
    def index(axis: str, d: int) -> str:
        if d == 0:
            return axis
        low, high = ("1", "6") if border == "reflect" else ("0", "7")
        return f"(CASE {axis} + {d} WHEN -1 THEN {low} WHEN 8 THEN {high} ELSE {axis} + {d} END)"
    return f"px[{index('y', dy)} * 8 + {index('x', dx)} + 1]"


_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_LAPLACIAN = " + ".join(_at(dy, dx, "reflect") for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))) + " - 4 * v"
_SHARPEN = "10 * v - (" + " + ".join(_at(dy, dx, "reflect") for dy, dx in _AROUND) + ")"
_MEDIAN = "list_sort([" + ", ".join(_at(dy, dx, "edge") for dy, dx in _AROUND) + "])[5]"
_QUALITY = f"""quality AS (SELECT vec_id, var_pop({_LAPLACIAN}) AS laplacian_var, avg(v) AS brightness FROM pixels GROUP BY vec_id)"""


def _hex(value: str) -> str:
    return f"string_agg(printf('%02x', cast({value} AS bigint)), '' ORDER BY y, x)"


_BRIGHT = """bright AS (SELECT vec_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM pixels WHERE v > 128 GROUP BY vec_id)"""

def _pixels_of(source: str) -> str:
    return f"SELECT vec_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS v, px FROM {source}, range(64) t(i)"


# Cleaning: sharpened where the variance is low, then the median; a file is the tag and the pixels, unless they are too bright.
_FILE = "CASE WHEN list_sum({0}) <= 200 * 64 THEN '47524159' || list_aggregate(list_transform({0}, lambda p: printf('%02x', p)), 'string_agg', '') END"
_PLAIN = "list_aggregate(list_transform({0}, lambda p: printf('%02x', p)), 'string_agg', '')"
_CLEANED = f""", {_QUALITY}, sharpened AS (SELECT vec_id, list(cast(CASE WHEN laplacian_var < 100 THEN greatest(0, least(255, {_SHARPEN})) ELSE v END AS bigint) ORDER BY y, x) AS px
        FROM pixels JOIN quality USING (vec_id) GROUP BY vec_id), sharp AS ({_pixels_of("sharpened")}),
        cleaned AS (SELECT vec_id, list(cast({_MEDIAN} AS bigint) ORDER BY y, x) AS px FROM sharp GROUP BY vec_id),
        stored AS (SELECT c.vec_id, {_FILE.format("c.px")} AS file, CASE WHEN {_FILE.format("c.px")} IS NULL THEN r.px ELSE c.px END AS px
                   FROM cleaned c JOIN rasters r USING (vec_id)),
        whitened AS (SELECT vec_id, file, px, list_transform(px, lambda p, i: CASE WHEN (i - 1) % 8 < 4 THEN p ELSE 255 END) AS white FROM stored),
        staged AS (SELECT * FROM image_products WHERE image_path IS NOT NULL AND sku IS NOT NULL AND price IS NOT NULL AND (title IS NOT NULL OR name IS NOT NULL))"""

ORACLE = {
    "image_quality": cte("rasters", "pixels") + f""", {_QUALITY} SELECT vec_id, round(laplacian_var, 6) AS laplacian_var, round(brightness, 6) AS brightness,
        laplacian_var < 100 AS is_blurred, brightness > 200 AS is_glare FROM quality""",
    "image_quality_report": cte("rasters", "pixels") + f""", {_QUALITY} SELECT 'label-' || label AS platform, count(*) AS n_images, count(*) FILTER (laplacian_var < 100) AS n_blurred,
        count(*) FILTER (brightness > 200) AS n_glare, 0::bigint AS n_unreadable FROM quality JOIN embeddings USING (vec_id) GROUP BY label""",
    "image_sharpen": cte("rasters", "pixels") + f"SELECT vec_id, {_hex(f'greatest(0, least(255, {_SHARPEN}))')} AS pixels, 'SUCCESS' AS state FROM pixels GROUP BY vec_id",
    "image_median": cte("rasters", "pixels") + f"SELECT vec_id, {_hex(_MEDIAN)} AS pixels, 'SUCCESS' AS state FROM pixels GROUP BY vec_id",
    "image_clean_states": """SELECT 'label-' || label AS platform, CASE label WHEN 1 THEN 'FAILED_EMPTY' WHEN 2 THEN 'FAILED_EXCEPTION' WHEN 3 THEN 'FAILED_DECODE' ELSE 'SUCCESS' END AS cleaning_state,
        count(*) AS n FROM embeddings GROUP BY label""",
    "fit_sizes": """SELECT p_partkey, greatest(1, round(w * s))::bigint AS target_width, greatest(1, round(h * s))::bigint AS target_height FROM (
        SELECT *, least(1.0::double, 800.0::double / w, 800.0::double / h) AS s FROM (SELECT p_partkey, p_size * 40 AS w, 2000 - p_size * 30 AS h FROM part))""",
    "normalize_image": cte("rasters", "pixels") + f"""SELECT vec_id, 4::bigint AS height, 4::bigint AS width, {_hex('round_even(m, 0)')} AS pixels, 'SUCCESS' AS state
        FROM (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) AS m FROM pixels GROUP BY ALL) GROUP BY vec_id""",
    "whiten_background": cte("rasters", "pixels") + f"SELECT vec_id, {_hex('CASE WHEN x < 4 THEN v ELSE 255 END')} AS pixels, 'SUCCESS' AS transform_state FROM pixels GROUP BY vec_id",
    "crop_objects": cte("rasters", "pixels") + f"""SELECT vec_id, 6::bigint AS height, 5::bigint AS width, vec_id % 2 = 0 AS mask_applied,
        {_hex('CASE WHEN vec_id % 2 = 0 AND x >= 4 THEN 255 ELSE v END')} AS pixels FROM pixels WHERE y >= 2 AND x < 5 GROUP BY vec_id""",
    "model_detections": cte("rasters", "pixels") + f""", {_BRIGHT} SELECT vec_id, 0::bigint AS det_idx, 0.5::double AS confidence, 1::bigint AS class_id, 0.0::double AS b0, 0.0::double AS b1, 8.0::double AS b2, 8.0::double AS b3 FROM bright
        UNION ALL SELECT vec_id, 1, 0.75, 0, x1, y1, x2, y2 FROM bright""",
    "object_records": cte("rasters", "pixels", "image_products") + f""", {_BRIGHT} SELECT product_id || '_obj0' AS sub_id, coalesce(sku, product_id) AS sku, coalesce(nullif(name, ''), title) AS name,
        's3://products/processing/objects/' || coalesce(sku, product_id) || '/' || product_id || '_obj0.jpg' AS object_path, false AS mask_applied, 4::bigint AS embedding_dim, 0.75::double AS confidence
        FROM bright JOIN image_products ON image_id = vec_id::varchar""",
    "index_job": cte("rasters", "pixels", "image_products") + f""", {_BRIGHT}, quarters AS (SELECT vec_id, {", ".join(
        f"coalesce(round(avg(v) FILTER (y {a} y1 + (y2 - y1) // 2 AND x {b} x1 + (x2 - x1) // 2)::float::double, 6), 'nan'::double) AS v{k}"
        for k, (a, b) in enumerate((("<", "<"), ("<", ">="), (">=", "<"), (">=", ">="))))}
        FROM pixels JOIN bright USING (vec_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY vec_id)
        SELECT product_id || '_obj0' AS sub_id, coalesce(sku, product_id) AS sku, coalesce(nullif(name, ''), title) AS name, v0, v1, v2, v3
        FROM quarters JOIN image_products ON image_id = vec_id::varchar""",
    "preprocessing_clean_files": cte("rasters", "pixels", "image_products") + _CLEANED + f"""
        SELECT product_id, CASE WHEN file IS NULL THEN 'FAILED_ENCODE' ELSE 'SUCCESS' END AS cleaning_state, file IS NOT NULL AS is_encoded,
        coalesce(file, {_PLAIN.format("px")}) AS file FROM whitened JOIN staged ON image_id = vec_id::varchar""",
    "preprocessing_job": cte("rasters", "pixels", "image_products") + _CLEANED + f"""
        SELECT product_id, sku, coalesce(name, title) AS name, round(price, 2) AS price,
        CASE WHEN w.file IS NULL THEN 'FAILED_ENCODE' ELSE 'SUCCESS' END AS cleaning_state, 'SUCCESS' AS integrate_state,
        CASE WHEN {_FILE.format("white")} IS NULL THEN 'FAILED_ENCODE' ELSE 'SUCCESS' END AS transform_state,
        's3://products/preprocessing/clean/' || product_id || '.jpg' AS clean_path, 's3://products/preprocessing/transform/' || product_id || '.jpg' AS transform_path,
        w.file IS NOT NULL OR {_FILE.format("white")} IS NOT NULL AS is_encoded, coalesce({_FILE.format("white")}, w.file, {_PLAIN.format("px")}) AS file
        FROM whitened w JOIN staged ON image_id = vec_id::varchar""",
    "labelled_objects": cte("rasters", "pixels", "image_products") + f""", {_BRIGHT} SELECT product_id || '_obj' || i AS sub_id, coalesce(sku, product_id) AS sku_label,
        CASE i WHEN 0 THEN 0.5 ELSE 0.75 END::double AS confidence, CASE i WHEN 0 THEN 64 ELSE (x2 - x1) * (y2 - y1) END::bigint AS n_bytes
        FROM bright JOIN image_products ON image_id = vec_id::varchar, range(2) t(i)""",
}
