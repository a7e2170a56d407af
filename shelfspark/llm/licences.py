"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings) and its digest is looked up
among those of known licence texts. Entire texts are looked up: each document as a whole, and each of its lines as a text of its own, which
finds notices. Every known text holds one of a few cue words, so a text or line without one is no licence and is not normalised.

Defined cases: null and empty texts have no licence; every row gives one row, repeated rows too; null ids are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.llm.common import text_or_empty
from shelfspark.llm.licence_texts import EQUIVALENT_SPELLINGS, KNOWN_TEXTS

#: One of these is in every known text.
CUE = r"(?i)licen[cs]e|released under|permission|public domain|redistribution|spdx"
COPYRIGHT_LINE = (r"(?im)^[^\p{L}\p{N}©(]*(?:copyright\s*(?:\(c\)|©|[<\[]?y|[0-9]{4}|by\s|holders?\s*$)|\(c\)\s|©|all rights reserved).*$")


def canonical(text: Column) -> Column:
    """Lower-case words of letters and digits, one space apart, without copyright lines, in one spelling."""
    bare = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    words = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))
    return reduce(lambda so_far, pair: F.regexp_replace(so_far, rf"\b{pair[0]}\b", pair[1]), EQUIVALENT_SPELLINGS, words)


def known_digests(spark: SparkSession, known: dict[str, list[str]] = KNOWN_TEXTS) -> DataFrame:
    """(licence, digest) of the known texts; a digest stands for one licence."""
    rows = [(name, text) for name, texts in sorted(known.items()) for text in texts]
    table = spark.createDataFrame(rows, "licence string, body string")
    return table.groupBy(F.sha2(canonical(F.col("body")), 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, licence, notices, n_notices) of every row: the licence the whole text is, the licences its lines name, and how many lines do.

    ``known`` has the columns licence and digest and is the fixed table of known texts, hence broadcast.
    """
    text = text_or_empty("text")
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: line.rlike(CUE))
    units = F.when(text.rlike(CUE), F.concat(F.array(text), lines))
    each = (documents.select("doc_id", F.monotonically_increasing_id().alias("_row"), units.alias("_units"))
            .select("doc_id", "_row", F.posexplode_outer("_units").alias("_at", "_unit")))
    digests = each.select("doc_id", "_row", "_at", F.when(F.col("_unit").isNotNull(), F.sha2(canonical(F.col("_unit")), 256)).alias("digest"))
    found = digests.join(F.broadcast(known), "digest", "left")
    whole, line = F.col("_at") == 0, F.col("_at") > 0
    return found.groupBy("_row", "doc_id").agg(
        F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(line, F.col("licence"))))).alias("notices"),
        F.count(F.when(line, F.col("licence"))).alias("n_notices")).drop("_row")
