"""Batch inference with models the caller supplies.

A *model factory* is a function without arguments that returns the model; it is called once per task. Models take a list of
images: a detector returns for each a list of dicts with ``bbox, confidence, class_id`` and optionally ``mask`` (an
array of 0/1), an embedder returns a vector for each. If a call fails, its images are tried one by one, so that only those that
fail alone are lost; they can be had as rows with their error. Detections are made, cropped and selected while the image is at
hand, so image bytes are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfspark.functions import ids
from shelfspark.functions.text import crop_object_name, s3_path
from shelfspark.operators.detections import CONFIDENCE, label_detections, metadata_expressions
from shelfspark.operators.images import crop, fit_mask, to_array
from shelfspark.schemas import RASTER

Detector = Callable[[list[np.ndarray]], Sequence[Sequence[dict]]]
Embedder = Callable[[list[np.ndarray]], Sequence[Sequence[float]]]

#: Images of one model call, and bytes of crops after which rows are handed on.
CALL_IMAGES, EMIT_BYTES = 32, 64 << 20

_CROP = ("crop_height", "crop_width", "crop_channels", "crop_data")
_FOUND: dict[str, tuple[T.DataType, pa.DataType]] = {
    "det_idx": (T.IntegerType(), pa.int32()), "bbox": (T.ArrayType(T.FloatType()), pa.list_(pa.float32())),
    "confidence": (T.FloatType(), pa.float32()), "class_id": (T.IntegerType(), pa.int32()),
    "mask": (T.BinaryType(), pa.binary()), "mask_height": (T.IntegerType(), pa.int32()), "mask_width": (T.IntegerType(), pa.int32()),
    "crop_height": (T.IntegerType(), pa.int32()), "crop_width": (T.IntegerType(), pa.int32()),
    "crop_channels": (T.IntegerType(), pa.int32()), "crop_data": (T.BinaryType(), pa.binary()), "error": (T.StringType(), pa.string())}


def _results(model, images: list[np.ndarray | Exception]) -> list:
    """The model's answer, or the error, for each image; those that could not be read keep their own error."""
    readable = [k for k, image in enumerate(images) if not isinstance(image, Exception)]
    out = list(images)
    try:
        answers = list(model([images[k] for k in readable])) if readable else []
        if len(answers) != len(readable):
            raise ValueError(f"{len(answers)} answers for {len(readable)} images")
    except Exception:
        answers = []
        for k in readable:
            try:
                answers.append(model([images[k]])[0])
            except Exception as error:
                answers.append(error)
    for k, answer in zip(readable, answers, strict=True):
        out[k] = answer
    return out


def _images(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray | Exception]:
    out: list[np.ndarray | Exception] = []
    for height, width, channels, data in zip(*(batch.column(batch.schema.get_field_index(n)) for n in names), strict=True):
        try:
            out.append(to_array(height.as_py(), width.as_py(), channels.as_py(), data.as_py()))
        except Exception as error:
            out.append(error)
    return out


def _records(image: np.ndarray, found: Sequence[dict], confidence: float, best_only: bool, with_crop: bool, apply_mask: bool) -> Iterator[dict]:
    """Rows for the detections of one image; a box without area inside the image has no crop and gives no row where crops are asked for."""
    found = [d for d in found if d["confidence"] >= confidence]
    if best_only:
        found = sorted(found, key=lambda d: -d["confidence"])[:1]
    for index, d in enumerate(found):
        mask = None if d.get("mask") is None else (np.asarray(d["mask"]) != 0).astype(np.uint8)
        record = {"det_idx": index, "bbox": [float(v) for v in d["bbox"]], "confidence": float(d["confidence"]), "class_id": int(d["class_id"])}
        if mask is not None:
            record |= {"mask": mask.tobytes(), "mask_height": mask.shape[0], "mask_width": mask.shape[1]}
        if with_crop:
            h, w = image.shape[:2]
            x1, y1, x2, y2 = (int(v) for v in d["bbox"])
            x1, x2 = (min(max(v, 0), w) for v in (x1, x2))
            y1, y2 = (min(max(v, 0), h) for v in (y1, y2))
            if x2 <= x1 or y2 <= y1:
                continue
            fitted = None if mask is None or not apply_mask else fit_mask(mask.tobytes(), *mask.shape, h, w)
            piece = np.ascontiguousarray(crop(image, [x1, y1, x2, y2], fitted))
            record |= dict(zip(_CROP, (*piece.shape, piece.tobytes()), strict=True))
        yield record


def detect(df: DataFrame, model_factory: Callable[[], Detector], confidence: float = CONFIDENCE,
           keep: Sequence[str] = ("image_id",), best_only: bool = False, with_crop: bool = False, apply_mask: bool = True,
           with_errors: bool = False, call_images: int = CALL_IMAGES) -> DataFrame:
    """One row per detection at or above ``confidence``, with the columns in ``keep``.

    ``best_only`` keeps the most confident one of each image (the first on ties). Crops are white outside the mask if ``apply_mask``.
    ``with_errors`` adds a row with the column ``error`` for each image that could not be read or on which the model failed.
    """
    names = [n for n in _FOUND if (with_crop or n not in _CROP) and (with_errors or n != "error")]
    sought = df if with_errors else df.filter(F.col("data").isNotNull() & (F.col("height") > 0))
    readable = sought.select(*keep, F.struct(*RASTER.names).alias("_raster"))
    schema = T.StructType([*readable.schema.fields[:len(keep)], *[T.StructField(n, _FOUND[n][0]) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()

        def emit(part: pa.RecordBatch, rows: list[tuple[int, dict]]) -> pa.RecordBatch:
            at = pa.array([k for k, _ in rows], pa.int64())
            kept = [part.column(k).take(at) for k in range(len(keep))]
            return pa.RecordBatch.from_arrays([*kept, *[pa.array([r.get(n) for _, r in rows], _FOUND[n][1]) for n in names]], names=schema.names)

        for batch in batches:
            for start in range(0, batch.num_rows, call_images):
                part = batch.slice(start, call_images)
                raster = pa.RecordBatch.from_struct_array(part.column(len(keep)))
                images = _images(raster, RASTER.names)
                if with_errors:
                    images = [ValueError("no image") if isinstance(i, np.ndarray) and not len(i) else i for i in images]
                rows, size = [], 0
                for k, (image, answer) in enumerate(zip(images, _results(model, images), strict=True)):
                    try:
                        if isinstance(answer, Exception):
                            raise answer
                        for record in _records(image, answer, confidence, best_only, with_crop, apply_mask):
                            rows.append((k, record))
                            size += len(record.get("crop_data") or b"") + len(record.get("mask") or b"")
                            if size >= EMIT_BYTES:
                                yield emit(part, rows)
                                rows, size = [], 0
                    except Exception as error:
                        if with_errors:
                            rows.append((k, {"error": f"{type(error).__name__}: {error}"}))
                yield emit(part, rows)

    return readable.mapInArrow(run, schema)


def embed(df: DataFrame, model_factory: Callable[[], Embedder], prefix: str = "crop_",
          out: str = "embedding", call_images: int = CALL_IMAGES) -> DataFrame:
    """Add the vector of the raster in ``<prefix>height … <prefix>data``; empty where the model fails."""
    channels = f"{prefix}channels" if f"{prefix}channels" in df.columns else f"{prefix}n_channels"
    raster = [f"{prefix}height", f"{prefix}width", channels, f"{prefix}data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        for batch in batches:
            for start in range(0, batch.num_rows, call_images):
                part = batch.slice(start, call_images)
                vectors = [np.empty(0, np.float32) if isinstance(v, Exception) else np.asarray(v, dtype=np.float32)
                           for v in _results(model, _images(part, raster))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def label(df: DataFrame, model_factory: Callable[[], Detector], products: DataFrame,
          confidence: float = CONFIDENCE) -> DataFrame:
    """All detections with their crop, the whole box without masking, and the sku of their product as label."""
    return label_detections(detect(df, model_factory, confidence, with_crop=True, apply_mask=False), products)


def object_records(df: DataFrame, detector: Callable[[], Detector], embedder: Callable[[], Embedder],
                   confidence: float = CONFIDENCE, bucket: str = "products") -> DataFrame:
    """Best object of each image: cropped, embedded and given the metadata of its product.

    ``df`` holds raster columns, ``image_id`` and the product columns in one row.
    """
    metadata = metadata_expressions(df)
    product = F.struct(*[column.alias(name) for name, column in metadata.items()])
    named = df.select("image_id", *RASTER.names, product.alias("_product"))
    found = embed(detect(named, detector, confidence, keep=("image_id", "_product"), best_only=True, with_crop=True),
                  embedder)
    flat = found.select(*[F.col(f"_product.{c}").alias(c) for c in metadata], *[
        c for c in found.columns if c not in ("_product",)])
    out = flat.withColumns({
        "sub_id": ids.sub_id(F.col("original_id"), F.col("det_idx")),
        "mask_applied": F.col("mask").isNotNull(),
        "embedding_dim": F.size("embedding"),
    })
    return out.withColumn("object_path", F.when(
        F.octet_length("crop_data") > 0, s3_path(bucket, crop_object_name(F.col("sku"), F.col("sub_id")))).otherwise(""))

