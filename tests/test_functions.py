"""Column functions on edge rows."""

import hashlib
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import ids, text, vectors


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def results(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_strip_removes_all_white_space(spark):
    values = ["\t a b \n", " x ", "", None, "\x1cy\x1f"]
    assert results(column(spark, values), text.strip_text(F.col("v"))) == [v.strip() if v is not None else None for v in values]


@pytest.mark.parametrize("value", ["n/a", " 12.5 ", "1e3", "", "12.5d", "0x1p3", "1_000", "1__0", ".5", "5.", "-3", "+2", "inf", "nan", "12,5", "1e", "\n7"])
def test_price_reads_numbers_as_python_does(spark, value):
    try:
        expected = float(value)
    except ValueError:
        expected = 0.0
    found = results(column(spark, [value]), text.price_or_zero(F.col("v")))[0]
    assert found == expected or (math.isnan(found) and math.isnan(expected))


def test_absent_price_stays_absent(spark):
    assert results(column(spark, [None]), text.price_or_zero(F.col("v"))) == [None]


def test_base_names_and_extensions(spark):
    import os.path
    names = ["a.jpg", "a.b.jpg", "a", ".json", "..x", "a..jpg", ".a.jpg", "a.JPG", "", None]
    df = column(spark, names)
    pairs = list(zip(results(df, text.base_name(F.col("v"))), results(df, text.extension(F.col("v")))))
    assert pairs == [os.path.splitext(n) if n is not None else (None, None) for n in names]


def test_bucket_split_accepts_both_forms(spark):
    df = column(spark, ["b/o/p.jpg", "s3://b/o/p.jpg", "nopath", "", None])
    assert [tuple(r) if r else None for r in results(df, text.split_bucket(F.col("v")))] == [
        ("b", "o/p.jpg"), ("b", "o/p.jpg"), None, None, None]


def test_last_segment(spark):
    df = column(spark, ["a/b/c", "a", "", None])
    assert results(df, text.last_segment(F.col("v"))) == ["c", "a", None, None]


def test_first_truthy_skips_empty_and_zero(spark):
    df = spark.createDataFrame([("", 0, "x"), (None, 7, "y"), ("a", 0, None), ("", 0, "")], "a string, b int, c string")
    assert results(df, text.first_truthy(df, ["a", "b", "missing", "c"], "none")) == ["x", "7", "a", "none"]


def test_uuid_equals_python(spark):
    found = results(column(spark, ["12", "é", ""]), ids.product_uuid(F.col("v")))
    assert found == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"tiki_{v}")) for v in ["12", "é", ""]]


def test_fingerprint_equals_python_json(spark):
    rows = [("é\"\\/", "b\n", 3, True), (None, "x", None, False)]
    df = spark.createDataFrame(rows, "z string, a string, n int, f boolean")
    documents = results(df, ids.sorted_json(["z", "a", "n", "f"]))
    expected = [json.dumps(dict(zip("zanf", r)), ensure_ascii=False, sort_keys=True) for r in rows]
    assert documents == expected


def test_hash_is_stable_and_non_negative(spark):
    names = [f"p{i}_obj0" for i in range(500)]
    found = results(column(spark, names), ids.point_id(F.col("v")))
    assert found == [int(hashlib.md5(n.encode()).hexdigest()[:16], 16) % 2**63 for n in names]


def test_leaf_target_range(spark):
    targets = results(spark.range(3000), ids.leaf_target(F.col("id")))
    assert min(targets) >= 9000 and max(targets) <= 11000 and len(set(targets)) > 1000
    assert targets == results(spark.range(3000), ids.leaf_target(F.col("id")))


def test_listing_url(spark):
    df = spark.createDataFrame([("7", "cà phê"), ("7", "")], "leaf string, kw string")
    assert results(df, text.listing_url("u", F.col("leaf"), F.col("kw"), F.lit(2))) == [
        "u?limit=40&q=c%C3%A0+ph%C3%AA&category=7&page=2", "u?limit=40&category=7&page=2"]


def test_run_time_is_printed_in_utc(spark):
    df = spark.sql("SELECT timestamp'2024-05-06 07:08:09.123456' AS t")
    assert results(df, ids.utc_iso(F.col("t"))) == ["2024-05-06T07:08:09.123456+00:00"]
    assert results(df, ids.utc_day(F.col("t"))) == ["2024-05-06"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [1.0]), (None, [1.0])],
                               "a array<float>, b array<float>")
    assert results(df, F.round(vectors.cosine(F.col("a"), F.col("b")), 9)) == [0.96, None, None, None, None]
    units = results(df, vectors.l2_normalize(F.col("a")))
    assert units[0] == pytest.approx([0.6, 0.8]) and units[1] is None and units[4] is None
    assert results(df, vectors.not_empty(F.col("a"))) == [True, True, True, False, False]


def test_labels(spark):
    df = spark.createDataFrame([(3.14159, ""), (2.0, "x"), (0.0, None)], "p double, s string")
    assert results(df, text.price_label(F.col("p"))) == ["$3.14", "$2.00", "$0.00"]
    assert results(df, text.sku_label(F.col("s"))) == ["SKU: N/A", "SKU: x", "SKU: N/A"]
