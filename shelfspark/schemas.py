"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, DOUBLE, FLOAT, INT, LONG = T.StringType(), T.DoubleType(), T.FloatType(), T.IntegerType(), T.LongType()
VECTOR = T.ArrayType(FLOAT)


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


#: One product document; whatever the typed core does not name stays in ``body``.
RAW_PRODUCT = _fields(
    source_file=STRING, id=STRING, product_id=STRING, barcode=STRING, sku=STRING, name=STRING,
    title=STRING, price=STRING, source=STRING, platform=STRING, primary_category_path=STRING,
    thumbnail_url=STRING, url_path=STRING, image_path=STRING, body=T.VariantType(),
)

#: Canonical product, without the image bytes.
CANONICAL = _fields(
    product_id=STRING, platform=STRING, sku=STRING, name=STRING, price=DOUBLE,
    image_path=STRING, cleaning_state=STRING, integrate_state=STRING,
)

DETECTION = _fields(
    image_id=STRING, det_idx=INT, bbox=VECTOR, confidence=FLOAT, class_id=INT, mask=T.BinaryType(),
)

#: Object metadata as stored; the crop itself lives in a content table.
OBJECT_META = _fields(
    original_id=STRING, sub_id=STRING, sku=STRING, name=STRING, price=DOUBLE, platform=STRING,
    image_path=STRING, object_path=STRING, bbox=VECTOR, confidence=FLOAT, class_id=INT,
    mask_applied=T.BooleanType(), embedding=VECTOR, embedding_dim=INT,
)

POINT = T.StructType([
    T.StructField("point_id", LONG, True),
    T.StructField("vector", VECTOR, True),
    T.StructField("payload", T.StructType([f for f in OBJECT_META if f.name != "embedding"]), True),
])

#: A raster: the fields of Spark's ``image`` source struct, flattened. Channels are in BGR(A) order.
RASTER = _fields(height=INT, width=INT, n_channels=INT, data=T.BinaryType())

# The states a stage may record.
STATE_OK = "SUCCESS"
STATE_EMPTY = "FAILED_EMPTY"
STATE_DECODE = "FAILED_DECODE"
STATE_ENCODE = "FAILED_ENCODE"
STATE_EXCEPTION = "FAILED_EXCEPTION"
STATE_UNKNOWN = "UNKNOWN"
