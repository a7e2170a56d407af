"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

#: Long texts are worked off in pieces of about this many bytes.
PIECE_BYTES = 1 << 18


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` has not got (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_id(df: DataFrame, column: str) -> Column:
    """An id or place as it is; whole numbers of any width as 64 bits."""
    return F.col(column).cast("bigint") if isinstance(df.schema[column].dataType, IntegralType) else F.col(column)


def text_or_empty(column: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def pieces(data: bytes, spaces: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` cut right behind white space (any byte of ``spaces``) into pieces of about ``size`` bytes.

    A run without white space stays whole, so that no word is cut.
    """
    start, n = 0, len(data)
    while n - start > size:
        cut = start + size
        while cut < n and data[cut] not in spaces:
            cut += 1
        if cut >= n:
            break
        yield data[start:cut + 1]
        start = cut + 1
    if start < n or not n:
        yield data[start:]
