"""Static dimensions of the category tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# The root categories.
ROOT_CATEGORIES = (
    ("4384", "Bách Hóa Online - Thực Phẩm"),
    ("1883", "Nhà Cửa - Đời Sống"),
    ("1520", "Làm Đẹp - Sức Khỏe"),
    ("8322", "Sách, VPP & Quà Tặng"),
    ("1789", "Điện thoại - Máy tính bảng"),
    ("1815", "Thiết bị số - Phụ kiện số"),
    ("1882", "Điện Gia Dụng"),
    ("2549", "Đồ Chơi - Mẹ & Bé"),
    ("8594", "Ô Tô - Xe Máy - Xe Đạp"),
    ("931", "Thời trang nữ"),
    ("915", "Thời trang nam"),
    ("1846", "Laptop - Máy Vi Tính - Linh kiện"),
    ("4221", "Điện Tử - Điện Lạnh"),
    ("1703", "Giày - Dép nữ"),
    ("1686", "Giày - Dép nam"),
)


def root_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROOT_CATEGORIES, "root string, root_name string")


def keyword_dimension(spark: SparkSession, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(root, keywords)`` from the caller's keyword lists, one row per root."""
    return spark.createDataFrame([(root, list(words)) for root, words in keywords.items()],
                                 "root string, keywords array<string>")
