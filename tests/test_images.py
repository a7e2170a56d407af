"""Image jobs against per-pixel loops, and decoding through the image source."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import images as I, inference
from shelfspark.schemas import RASTER
from shelfspark.sources.images import read_content, read_images, with_any_bytes, with_image_bytes

SCHEMA = "image_id string, height int, width int, n_channels int, data binary"


def table(spark, pictures):
    rows = []
    for name, p in pictures.items():
        if isinstance(p, np.ndarray):
            p = p if p.ndim == 3 else p[:, :, None]
            rows.append((name, *p.shape, bytearray(p.tobytes())))
        else:
            rows.append((name, *p))
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df, key="image_id"):
    return {r[key]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels) if r.data else None for r in df.collect()}


def at(p, y, x, border):
    h, w = p.shape
    if border == "edge":
        return int(p[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    y = -y if y < 0 else 2 * (h - 1) - y if y >= h else y
    x = -x if x < 0 else 2 * (w - 1) - x if x >= w else x
    return int(p[y, x])


def around(p, border):
    return [[[at(p, y + dy, x + dx, border) for dy in (-1, 0, 1) for dx in (-1, 0, 1)] for x in range(p.shape[1])] for y in range(p.shape[0])]


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).integers(0, 256, size=(7, 9, 3), dtype=np.uint8)


def test_quality(spark, noise):
    flat = np.full((4, 4, 3), 230, np.uint8)
    got = {r.image_id: r for r in I.with_quality(table(spark, {"noise": noise, "flat": flat, "bad": (-1, -1, -1, None)})).collect()}
    gray = np.array([[int(1868 * b + 9617 * g + 4899 * r + 8192) >> 14 for b, g, r in row] for row in noise.astype(int)], np.uint8)
    lap = np.array([[n[1] + n[3] + n[5] + n[7] - 4 * n[4] for n in row] for row in around(gray, "reflect")])
    assert got["noise"].laplacian_var == pytest.approx(lap.var()) and got["noise"].brightness == pytest.approx(gray.mean())
    assert not got["noise"].is_blurred and got["flat"].is_blurred and got["flat"].is_glare
    assert got["bad"].laplacian_var is None
    report = I.quality_report(I.with_quality(table(spark, {"flat": flat})).withColumn("platform", F.lit("x"))).first()
    assert (report.n_images, report.n_blurred, report.n_glare, report.median_brightness) == (1, 1, 1, 230.0)


def test_cleaning_states_and_pixels(spark, noise):
    smooth = (np.add.outer(np.arange(8), np.arange(8)) * 2 + 100).astype(np.uint8)
    pictures = {"noise": noise, "smooth": smooth, "empty": (4, 4, 1, None), "broken": (-1, -1, -1, bytearray(b"x")),
                "short": (4, 4, 1, bytearray(b"xy"))}
    out = I.clean_images(table(spark, pictures))
    states = {r.image_id: r.cleaning_state for r in out.collect()}
    assert states == {"noise": "SUCCESS", "smooth": "SUCCESS", "empty": "FAILED_EMPTY", "broken": "FAILED_DECODE", "short": "FAILED_EXCEPTION"}
    done = arrays(out.filter("cleaning_state = 'SUCCESS'"))
    for c in range(3):
        assert (done["noise"][:, :, c] == [[sorted(n)[4] for n in row] for row in around(noise[:, :, c], "edge")]).all()
    sharp = np.array([[min(max(10 * n[4] - sum(n), 0), 255) for n in row] for row in around(smooth, "reflect")], np.uint8)
    assert (done["smooth"][:, :, 0] == [[sorted(n)[4] for n in row] for row in around(sharp, "edge")]).all()
    assert out.filter("image_id = 'short'").first().data == b"xy"


def test_glare_step_and_encoder(spark):
    bright = np.full((4, 4), 250, np.uint8)
    out = I.clean_images(table(spark, {"b": bright}), repair_glare=lambda image, gray: image - 50, encode=lambda image: b"E" + image.tobytes())
    assert out.first().data == b"E" + bytes([200]) * 16

    def refuse(image):
        raise OSError
    assert I.clean_images(table(spark, {"b": bright}), encode=refuse).first().cleaning_state == "FAILED_ENCODE"


def test_codec_between_stages(spark):
    def encode(image):
        if image[0, 0, 0] == 7:
            raise OSError
        return b"E" + image.tobytes()

    def decode(data):
        if data == b"E?":
            raise OSError
        return np.frombuffer(data, np.uint8, offset=1).reshape(2, 2, 1)

    codec = I.Codec(encode, decode)
    pictures = {"good": np.full((2, 2), 30, np.uint8), "refused": np.full((2, 2), 7, np.uint8), "empty": (2, 2, 1, None)}
    cleaned = I.clean_images(table(spark, pictures), codec=codec)
    assert {r.image_id: (r.cleaning_state, r.is_encoded, r.data) for r in cleaned.collect()} == {
        "good": ("SUCCESS", True, b"E" + bytes([30] * 4)), "refused": ("FAILED_ENCODE", False, bytes([7] * 4)), "empty": ("FAILED_EMPTY", False, None)}
    # What could not be encoded is plain, and is read as such; damaged files and those of unknown format are told apart from failed steps.
    broken = cleaned.withColumn("data", F.when(F.col("image_id") == "good", F.lit(bytearray(b"E?"))).otherwise(F.col("data")))
    half = F.lit(bytearray([0, 1, 0, 1]))
    for frame, good in ((cleaned, ("SUCCESS", b"E" + bytes([255, 30, 255, 30]))), (broken, ("FAILED_DECODE", b"E?"))):
        white = {r.image_id: (r.transform_state, r.data) for r in I.whiten_background(frame.withColumn("foreground", half), codec=codec).collect()}
        assert white == {"good": good, "refused": ("SUCCESS", b"E" + bytes([255, 7, 255, 7])), "empty": ("FAILED_EMPTY", None)}


def test_normalising(spark):
    clear = np.zeros((2, 2, 4), np.uint8)
    clear[0, 0] = [10, 20, 30, 255]
    clear[0, 1] = [0, 0, 0, 128]
    wide = np.arange(4 * 12, dtype=np.uint8).reshape(4, 12)
    out = arrays(I.normalize_images(table(spark, {"clear": clear, "wide": wide}), limit=6))
    assert out["clear"].tolist() == [[[10, 20, 30], [127, 127, 127]], [[255, 255, 255], [255, 255, 255]]]
    assert out["wide"].shape == (2, 6, 1)
    assert out["wide"][:, :, 0].tolist() == np.rint(wide.reshape(2, 2, 6, 2).mean(axis=(1, 3))).tolist()


def test_crops(spark, noise):
    pictures = table(spark, {"n": noise})
    mask = np.zeros((7, 9), np.uint8)
    mask[2:5, 3:6] = 255
    boxes = spark.createDataFrame([("n", 0, [1.9, 2.0, 20.0, 6.5], None), ("n", 1, [-3.0, 0.0, 7.0, 7.0], bytearray(mask.tobytes())),
                                   ("n", 2, [30.0, 0.0, 40.0, 5.0], None), ("n", 3, [0.0, 0.0, 2.0, 2.0], bytearray(b"bad"))],
                                  "image_id string, det_idx int, bbox array<double>, mask binary")
    out = I.crop_objects(pictures, boxes, mask_unit=255)
    rows = {r.det_idx: r for r in out.collect()}
    assert sorted(rows) == [0, 1, 3]
    assert [rows[i].mask_applied for i in (0, 1, 3)] == [False, True, False]
    crops = arrays(out, "det_idx")
    assert (crops[0] == noise[2:6, 1:9]).all()
    assert (crops[1] == np.where(mask[:, :, None] > 0, noise, 255)[:, :7]).all()


def test_mask_transport(spark):
    df = spark.createDataFrame([("AQL/",), ("?!",), (None,)], "m string")
    assert [r[0] for r in df.select(I.decode_mask(F.col("m"))).collect()] == [b"\x01\x02\xff", None, None]


def test_mask_is_fitted_by_nearest_pixels():
    assert I.fit_mask(bytes([1, 0, 0, 1]), 2, 2, 4, 4).astype(int).tolist() == [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]]


def test_background(spark, noise):
    mask = np.zeros((7, 9), np.uint8)
    mask[1:3] = 1
    pictures = table(spark, {"n": noise}).withColumn("foreground", F.lit(bytearray(mask.tobytes())))
    out = I.whiten_background(pictures)
    assert (arrays(out)["n"] == np.where(mask[:, :, None] > 0, noise, 255)).all()
    assert I.whiten_background(pictures.withColumn("foreground", F.lit(None).cast("binary"))).first().transform_state == "FAILED_EXCEPTION"


def test_only_arrow_python(spark, noise):
    plan = I.clean_images(table(spark, {"n": noise}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan


def png(path, picture):
    h, w, _ = picture.shape
    raw = b"".join(b"\0" + row[:, ::-1].tobytes() for row in picture)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_files_are_decoded_and_bad_ones_flagged(spark, tmp_path, noise):
    png(tmp_path / "good.png", noise)
    (tmp_path / "junk.png").write_bytes(b"junk")
    (tmp_path / "empty.png").write_bytes(b"")
    rows = read_images(spark, str(tmp_path)).withColumn("image_id", F.element_at(F.split("image_id", "/"), -1))
    states = {r.image_id: r.cleaning_state for r in I.clean_images(rows).collect()}
    assert states["good.png"] == "SUCCESS" and states["junk.png"].startswith("FAILED")
    assert (arrays(rows.filter("image_id = 'good.png'"))["good.png"] == noise).all()


def test_bytes_by_path(spark, tmp_path):
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "a.jpg").write_bytes(b"A")
    (tmp_path / "bucket" / "t.jpg").write_bytes(b"T")
    content = read_content(spark, str(tmp_path), "*.jpg")
    df = spark.createDataFrame([(1, "bucket/a.jpg", None, None), (2, "s3://bucket/a.jpg", "s3://bucket/t.jpg", None), (3, None, "", None),
                                (4, "nowhere", None, None), (5, "bucket/a.jpg", None, bytearray(b"own")), (6, "bucket/none.jpg", None, bytearray(b""))],
                               "id int, image_path string, transform_path string, image_data binary")
    fetched = {r.id: r.image_data for r in with_image_bytes(df.drop("image_data"), content).collect()}
    assert fetched == {1: b"A", 2: b"A", 3: None, 4: None, 5: b"A", 6: None}
    assert {r.id: bytes(r.image_data) for r in with_any_bytes(df, content).collect()} == {1: b"A", 2: b"T", 5: b"own"}


def each(model):
    return lambda images: [model(image) for image in images]


def boxes_of(image):
    if image[0, 0, 0] == 13:
        raise RuntimeError
    full = [0, 0, image.shape[1], image.shape[0]]
    return [{"bbox": full, "confidence": 0.5, "class_id": 1}, {"bbox": [1, 1, 3, 3], "confidence": 0.9, "class_id": 2, "mask": np.eye(4)},
            {"bbox": full, "confidence": 0.9, "class_id": 3}, {"bbox": full, "confidence": 0.4, "class_id": 4}]


def mean_of(image):
    if image[0, 0, 0] == 77:
        raise RuntimeError
    return [float(image.mean()), float(image.shape[0])]


def test_detection_embedding_and_records(spark):
    bad = np.full((4, 4), 13, np.uint8)
    pictures = table(spark, {"a": np.full((4, 4), 40, np.uint8), "bad": bad, "none": (4, 4, 1, None), "odd": np.full((4, 4), 77, np.uint8)})
    found = inference.detect(pictures, lambda: each(boxes_of))
    assert sorted((r.image_id, r.det_idx, r.class_id) for r in found.collect()) == [
        (i, d, c) for i in ("a", "odd") for d, c in ((0, 1), (1, 2), (2, 3))]
    products = pictures.withColumns({"product_id": F.col("image_id"), "sku": F.lit(""), "title": F.lit("T"), "price": F.lit("3.5"),
                                     "image_path": F.lit(None).cast("string")})
    records = {r.sub_id: r for r in inference.object_records(products, lambda: each(boxes_of), lambda: each(mean_of)).collect()}
    assert sorted(records) == ["a_obj0", "odd_obj0"]
    one = records["a_obj0"]
    assert (one.class_id, one.mask_applied, one.sku, one.name, one.price, one.platform) == (2, True, "a", "T", 3.5, "")
    assert one.crop_data == bytes([40, 255, 255, 40]) and one.embedding_dim == 2
    assert one.object_path == "s3://products/processing/objects/a/a_obj0.jpg"
    assert records["odd_obj0"].embedding_dim == 0


def test_labels_keep_all_detections(spark):
    pictures = table(spark, {"a": np.full((4, 4), 40, np.uint8)})
    products = spark.createDataFrame([("a", "P", "S")], "image_id string, product_id string, sku string")
    found = inference.label(pictures, lambda: each(boxes_of), products)
    rows = sorted(found.collect(), key=lambda r: r.sub_id)
    assert [(r.sub_id, r.sku_label) for r in rows] == [("P_obj0", "S"), ("P_obj1", "S"), ("P_obj2", "S")]
    assert rows[1].mask is not None and rows[1].crop_data == bytes([40] * 4)  # labels show the box as it is


def test_models_see_several_images_a_call(spark):
    def counting():
        return lambda images: [[{"bbox": [0, 0, 1, 1], "confidence": 0.9, "class_id": len(images)}] for _ in images]

    pictures = table(spark, {f"p{k}": np.full((4, 4), k, np.uint8) for k in range(40)}).coalesce(1)
    seen = [r.class_id for r in inference.detect(pictures, counting, call_images=16).collect()]
    assert sorted(seen) == [8] * 8 + [16] * 32


def test_failures_are_rows_where_wanted(spark):
    pictures = table(spark, {"a": np.full((4, 4), 40, np.uint8), "bad": np.full((4, 4), 13, np.uint8), "short": (4, 4, 1, bytearray(b"x"))})
    found = inference.detect(pictures, lambda: each(boxes_of), with_errors=True).filter("error IS NOT NULL").collect()
    assert sorted((r.image_id, r.det_idx) for r in found) == [("bad", None), ("short", None)]


def test_unreadable_images_are_failures_too(spark):
    pictures = table(spark, {"a": np.full((4, 4), 40, np.uint8), "none": (4, 4, 1, None), "flat": (0, 4, 1, bytearray()), "null": (None, None, None, None)})
    found = inference.detect(pictures, lambda: each(boxes_of), with_errors=True)
    assert sorted(r.image_id for r in found.filter("error IS NOT NULL").collect()) == ["flat", "none", "null"]
    assert {r.image_id for r in inference.detect(pictures, lambda: each(boxes_of)).collect()} == {"a"}


def test_many_large_boxes_are_handed_on_in_parts(spark):
    def many():
        return lambda images: [[{"bbox": [0, 0, 800, 800], "confidence": 0.9, "class_id": k} for k in range(100)] for _ in images]

    pictures = table(spark, {f"p{k}": np.full((800, 800), k, np.uint8) for k in range(4)}).coalesce(1)
    found = inference.detect(pictures, many, with_crop=True)
    assert found.select(F.sum(F.octet_length("crop_data"))).first()[0] == 4 * 100 * 800 * 800


def test_raster_columns():
    assert RASTER.names == ["height", "width", "n_channels", "data"]
