"""Structured data embedded in landed web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_BLOCK = (r"(?s)(?i:<script)\b[^>]*?\s(?i:type)\s*=\s*"
          r"""(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s>]))[^>]*>(.*?)(?i:</script)""")


def structured_blocks(html: Column) -> Column:
    """Texts of all LD-JSON script elements, in page order."""
    return F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))


def with_structured_data(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``ld_json``: the block itself if one parses, an array if several do, else null.

    ``n_found`` and ``n_parsed`` count the blocks; broken ones are skipped.
    """
    texts = pages.withColumn("_texts", structured_blocks(F.col(html)))
    parsed = texts.withColumn(
        "_parsed", F.filter(F.transform("_texts", lambda t: F.try_parse_json(t)), lambda v: v.isNotNull()))
    several = F.parse_json(F.concat(F.lit("["), F.concat_ws(",", F.transform("_parsed", lambda v: F.to_json(v))), F.lit("]")))
    value = (F.when(F.size("_parsed") == 1, F.col("_parsed")[0]).when(F.size("_parsed") > 1, several))
    return (parsed.withColumns({"n_found": F.size("_texts").cast("bigint"), "n_parsed": F.size("_parsed").cast("bigint"),
                                "ld_json": value}).drop("_texts", "_parsed"))
