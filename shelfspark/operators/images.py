"""Jobs over tables of rasters: quality audit, cleaning, normalising, cropping, background.

A raster is ``height, width, n_channels, data`` with channels in BGR(A) order, as Spark's ``image``
source delivers them. Metrics, flags, sizes, boxes, states and reports are column expressions;
numpy touches pixels inside one Arrow stage per job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfspark.operators.detections import clamp_box
from shelfspark.schemas import RASTER, STATE_DECODE, STATE_EMPTY, STATE_ENCODE, STATE_EXCEPTION, STATE_OK

# Blur and glare thresholds, the sharpening kernel's centre, the bounding size,
# and the gray weights (14-bit fixed point, BGR order).
BLUR_BELOW = 100.0
GLARE_ABOVE = 200.0
SHARPEN_CENTRE = 9
MAX_SIDE = 800
GRAY_WEIGHTS = (1868, 9617, 4899)

ImageStep = Callable[[np.ndarray, np.ndarray], np.ndarray]
_RESULT = T.StructType([
    T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("n_channels", T.IntegerType()), T.StructField("data", T.BinaryType()),
    T.StructField("is_encoded", T.BooleanType()), T.StructField("state", T.StringType())])


@dataclass(frozen=True)
class Codec:
    """The caller's file format: an image to the bytes of a file, and back. Both run on the executors and may fail on an image."""

    encode: Callable[[np.ndarray], bytes]
    decode: Callable[[bytes], np.ndarray] | None = None


def to_array(height: int, width: int, n_channels: int, data: bytes) -> np.ndarray:
    """Raster row to ``(height, width, channels)``."""
    return np.frombuffer(data, np.uint8).reshape(height, width, n_channels)


def _gray(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0]
    weighted = image[:, :, :3].astype(np.int64) @ np.array(GRAY_WEIGHTS)
    return ((weighted + (1 << 13)) >> 14).astype(np.uint8)


def _neighbours(plane: np.ndarray, border: str) -> np.ndarray:
    """The 3x3 surroundings of every pixel, as a last axis of nine."""
    short = min(plane.shape[:2]) < 2
    padded = np.pad(plane, 1, mode="edge" if short else border)
    return np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).reshape(*plane.shape, 9)


def _metrics(gray: np.ndarray) -> tuple[float, float]:
    near = _neighbours(gray.astype(np.int64), "reflect")
    laplacian = near[..., 1] + near[..., 3] + near[..., 5] + near[..., 7] - 4 * near[..., 4]
    return float(laplacian.var()), float(gray.mean())


def _per_channel(image: np.ndarray, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([step(image[:, :, c]) for c in range(image.shape[2])], axis=2)


def _sharpen(plane: np.ndarray) -> np.ndarray:
    near = _neighbours(plane.astype(np.int64), "reflect")
    return np.clip((SHARPEN_CENTRE + 1) * near[..., 4] - near.sum(axis=-1), 0, 255).astype(np.uint8)


def _median(plane: np.ndarray) -> np.ndarray:
    return np.median(_neighbours(plane, "edge"), axis=-1).astype(np.uint8)


def _as_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + name).alias(name) for name in RASTER.names])


def _map_raster(df: DataFrame, step: Callable[[np.ndarray, dict], np.ndarray], extra: dict[str, Column],
                state_col: str, codec: Codec | None = None) -> DataFrame:
    """Replace each raster by ``step(image, row)``, recording a state.

    A row that fails keeps its raster and stays in the flow. With a codec, results are stored as its bytes, which the column ``is_encoded``
    tells apart from the pixels of rows that failed or come from elsewhere (null or no such column).
    """
    @F.pandas_udf(_RESULT)
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                kept = (row["height"], row["width"], row["n_channels"], row["data"], row["is_encoded"])
                if not row["data"]:
                    out.append((*kept[:3], None, False, STATE_EMPTY))
                    continue
                if not row["height"] or row["height"] < 0:
                    out.append((*kept, STATE_DECODE))
                    continue
                if codec and row["is_encoded"]:
                    try:
                        image = codec.decode(row["data"])
                    except Exception:
                        out.append((*kept, STATE_DECODE))
                        continue
                try:
                    if not (codec and row["is_encoded"]):
                        image = to_array(*[int(v) for v in kept[:3]], kept[3])
                    image = step(image, row)
                except Exception:
                    out.append((*kept, STATE_EXCEPTION))
                    continue
                try:
                    data = codec.encode(image) if codec else np.ascontiguousarray(image).tobytes()
                except Exception:
                    out.append((*kept, STATE_ENCODE))
                    continue
                out.append((*image.shape, data, codec is not None, STATE_OK))
            frame = pd.DataFrame(out, columns=_RESULT.names)
            for column in ("height", "width", "n_channels"):
                frame[column] = frame[column].astype("Int32")
            yield frame

    marked = F.coalesce(F.col("is_encoded"), F.lit(False)) if codec and "is_encoded" in df.columns else F.lit(False)
    inputs = F.struct(*RASTER.names, marked.alias("is_encoded"), *[c.alias(n) for n, c in extra.items()])
    fields = {name: F.col(f"_result.{name}") for name in [*RASTER.names, *(["is_encoded"] if codec else [])]}
    return df.withColumn("_result", apply(inputs)).withColumns({**fields, state_col: F.col("_result.state")}).drop("_result")


def from_image_source(df: DataFrame, image: str = "image") -> DataFrame:
    """Spark's ``image`` struct as raster columns; an undecodable file has height -1."""
    return df.select(
        *[c for c in df.columns if c != image], F.col(f"{image}.origin").alias("image_id"),
        F.col(f"{image}.height").alias("height"), F.col(f"{image}.width").alias("width"),
        F.col(f"{image}.nChannels").alias("n_channels"), F.col(f"{image}.data").alias("data"))


def with_quality(df: DataFrame) -> DataFrame:
    """Laplacian variance and mean brightness of the gray image, with blur and glare flags."""
    kind = T.StructType([T.StructField("laplacian_var", T.DoubleType()), T.StructField("brightness", T.DoubleType())])

    @F.pandas_udf(kind)
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for h, w, c, data in zip(batch["height"], batch["width"], batch["n_channels"], batch["data"]):
                readable = data and h > 0 and len(data) == h * w * c
                found.append(_metrics(_gray(to_array(int(h), int(w), int(c), data))) if readable else (None, None))
            yield pd.DataFrame(found, columns=kind.names, dtype="float64")

    return (df.withColumn("_q", measure(_as_struct())).withColumns({
        "laplacian_var": F.col("_q.laplacian_var"), "brightness": F.col("_q.brightness"),
        "is_blurred": F.col("_q.laplacian_var") < BLUR_BELOW, "is_glare": F.col("_q.brightness") > GLARE_ABOVE,
    }).drop("_q"))


def quality_report(measured: DataFrame, by: str = "platform") -> DataFrame:
    """Distribution of image quality per platform."""
    return measured.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_images"), F.count_if("is_blurred").alias("n_blurred"),
        F.count_if("is_glare").alias("n_glare"), F.count_if(F.col("laplacian_var").isNull()).alias("n_unreadable"),
        F.percentile_approx("laplacian_var", 0.5).alias("median_laplacian_var"),
        F.percentile_approx("brightness", 0.5).alias("median_brightness"))


def sharpen(df: DataFrame, state_col: str = "state") -> DataFrame:
    """3x3 sharpening of every image; borders are reflected without repeating the edge."""
    return _map_raster(df, lambda image, _: _per_channel(image, _sharpen), {}, state_col)


def median(df: DataFrame, state_col: str = "state") -> DataFrame:
    """3x3 median of every image; borders repeat the edge."""
    return _map_raster(df, lambda image, _: _per_channel(image, _median), {}, state_col)


def clean_images(df: DataFrame, repair_glare: ImageStep | None = None,
                 encode: Callable[[np.ndarray], bytes] | None = None, codec: Codec | None = None) -> DataFrame:
    """Sharpen blurred images, then take the median of all, with ``cleaning_state`` per row.

    Both flags are judged on the original gray image. ``repair_glare(image, gray)`` is applied to overexposed images last;
    ``codec`` reads what is encoded and turns the result into file bytes; ``encode`` alone does for images that are all plain.
    """
    def step(image: np.ndarray, _: dict) -> np.ndarray:
        gray = _gray(image)
        variance, brightness = _metrics(gray)
        if variance < BLUR_BELOW:
            image = _per_channel(image, _sharpen)
        image = _per_channel(image, _median)
        if repair_glare is not None and brightness > GLARE_ABOVE:
            image = repair_glare(image, gray)
        return image

    return _map_raster(df, step, {}, "cleaning_state", codec or (Codec(encode) if encode else None))


def target_size(df: DataFrame, limit: int = MAX_SIDE) -> DataFrame:
    """Size that fits ``limit`` x ``limit`` with the same proportions; never an enlargement."""
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.col("width"), F.lit(float(limit)) / F.col("height"))
    return df.withColumns({
        "target_width": F.greatest(F.lit(1), F.round(F.col("width") * scale).cast("int")),
        "target_height": F.greatest(F.lit(1), F.round(F.col("height") * scale).cast("int"))})


def _onto_white(image: np.ndarray) -> np.ndarray:
    if image.shape[2] != 4:
        return image
    alpha = image[:, :, 3:4].astype(np.int64)
    return ((image[:, :, :3].astype(np.int64) * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def _area_weights(size: int, target: int) -> np.ndarray:
    """Share of each source line in each target line."""
    edges = np.arange(target + 1) * (size / target)
    lines = np.arange(size)
    overlap = np.minimum(edges[1:, None], lines + 1) - np.maximum(edges[:-1, None], lines)
    return np.clip(overlap, 0, None) * (target / size)


def _shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    if (height, width) == image.shape[:2]:
        return image
    rows, columns = _area_weights(image.shape[0], height), _area_weights(image.shape[1], width)
    return np.clip(np.rint(np.einsum("ih,hwc,jw->ijc", rows, image, columns, optimize=True)), 0, 255).astype(np.uint8)


def normalize_images(df: DataFrame, limit: int = MAX_SIDE, state_col: str = "state") -> DataFrame:
    """Transparent parts onto white, then shrunk by area averages to fit the limit."""
    sizes = {"target_height": F.col("target_height"), "target_width": F.col("target_width")}
    out = _map_raster(
        target_size(df, limit),
        lambda image, row: _shrink(_onto_white(image), int(row["target_height"]), int(row["target_width"])),
        sizes, state_col)
    return out.drop("target_height", "target_width")


def fit_mask(mask: bytes, mask_height: int, mask_width: int, height: int, width: int, unit: int = 1) -> np.ndarray:
    """Mask brought to the image size by its nearest pixels; a pixel counts from the value ``unit`` on."""
    plane = np.frombuffer(mask, np.uint8).reshape(mask_height, mask_width) >= unit
    if (mask_height, mask_width) == (height, width):
        return plane
    rows = ((np.arange(height) + 0.5) * mask_height / height).astype(int)
    columns = ((np.arange(width) + 0.5) * mask_width / width).astype(int)
    return plane[np.ix_(rows, columns)]


def crop(image: np.ndarray, box: list[int], mask: np.ndarray | None) -> np.ndarray:
    """Box of the image, white outside the mask."""
    x1, y1, x2, y2 = box
    if mask is not None:
        image = np.where(mask[:, :, None], image, np.uint8(255))
    return image[y1:y2, x1:x2]


def decode_mask(mask_base64: Column) -> Column:
    """Bytes of a transported mask, of which 255 is foreground; null where the text is no base64."""
    return F.try_to_binary(mask_base64, F.lit("base64"))


def crop_objects(images: DataFrame, detections: DataFrame, mask_unit: int = 1) -> DataFrame:
    """Cut every detection out of its image; boxes are cut to the image and empty ones dropped.

    ``detections`` may carry ``mask`` (0/1 bytes, or 0/255 with ``mask_unit=255``) with ``mask_height`` and ``mask_width``, the
    image size being assumed where these are missing; a mask that does not fit is ignored, and ``mask_applied`` tells.
    """
    names = detections.columns
    mask = F.col("mask") if "mask" in names else F.lit(None).cast("binary")
    mask_h = F.col("mask_height") if "mask_height" in names else F.col("height")
    mask_w = F.col("mask_width") if "mask_width" in names else F.col("width")
    joined = images.select("image_id", *RASTER.names).join(detections, "image_id")
    joined = (joined.withColumn("box", clamp_box(F.col("bbox"), F.col("width"), F.col("height")))
              .filter(F.col("box").isNotNull()))
    fits = mask.isNotNull() & (F.octet_length(mask) == mask_h * mask_w)
    joined = joined.withColumn("mask_applied", F.coalesce(fits, F.lit(False)))

    def step(image: np.ndarray, row: dict) -> np.ndarray:
        applied = None
        if row["mask_applied"]:
            applied = fit_mask(row["mask"], int(row["mask_height"]), int(row["mask_width"]),
                               *image.shape[:2], mask_unit)
        return crop(image, [int(v) for v in row["box"]], applied)

    extra = {"box": F.col("box"), "mask_applied": F.col("mask_applied"), "mask": mask,
             "mask_height": mask_h, "mask_width": mask_w}
    cut = _map_raster(joined, step, extra, "crop_state")
    return cut.select(*names, "box", "mask_applied", *RASTER.names, "crop_state")


def whiten_background(df: DataFrame, mask: str = "foreground", codec: Codec | None = None) -> DataFrame:
    """Everything outside the 0/1 mask column becomes white, with ``transform_state`` per row; ``codec`` reads what is encoded and encodes the result."""
    def step(image: np.ndarray, row: dict) -> np.ndarray:
        plane = np.frombuffer(row["mask"], np.uint8).reshape(image.shape[:2])
        return np.where((plane != 0)[:, :, None], image, np.uint8(255))

    return _map_raster(df, step, {"mask": F.col(mask)}, "transform_state", codec)
