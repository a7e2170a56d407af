"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is the hash of five words at the cared-for positions of a fixed mask; the masks are five words in a row, the four spans of six
with one inner position ignored, and four words and the third one after. A passage that agrees with a benchmark item in 0.8 or more of six or
more words, word for word, holds a seed of the item (tests enumerate the patterns without one). An item of five words is found whole only. Hits are joined by hash where the documents are read; of a
row of hits along one alignment only the leftmost goes on, and the alignment around it is compared word by word.

An overlap counts if 0.8 of the item's words agree at their places, or if a stretch of it (a match is worth 1, a
substitution costs 4) has at least eight and at least half of the item's words agreeing, or at least 13, however long the item is. Alignments
are judged one by one: of a passage with inserted or missing words, the parts between them.

Defined cases: words are lower-cased runs without ASCII white space and punctuation; null and empty texts have none; items and documents of
fewer than five words never match; repeated rows give one result per (doc_id, item_id); null ids are kept as null; empty
tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.llm.common import fresh, text_or_empty

#: Cared-for positions of each mask.
MASKS = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5), (0, 1, 2, 3, 6))
#: Seeds that may be broadcast at once, at about 100 bytes each however long their items are; a larger benchmark is searched in several slices.
BROADCAST_SEEDS = 1_000_000
_SEPARATORS = r"[\s\p{Punct}]+"


def word_hashes(text: str | Column) -> Column:
    """One hash for each word of a text."""
    words = F.split(F.lower(F.regexp_replace(text_or_empty(text), "^" + _SEPARATORS, "")), _SEPARATORS)
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(h: str, i: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(F.col(h), F.col(i) + k) for k in MASKS[number]])


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, words, key): the word hashes of each item, trailing separators left out, and a key of the words."""
    trimmed = F.regexp_replace(text_or_empty("text"), _SEPARATORS + "$", "")
    items = benchmark.select(F.col("item_id").alias("_item"), word_hashes(trimmed).alias("_words"))
    return items.filter(F.size("_words") >= len(MASKS[0])).distinct().withColumn("_key", F.xxhash64("_words"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, key, length, at, before): every complete seed of all different words of items and the word in front of it, in rows of one size.

    The words themselves stay out: they are joined to the hits by key. Should two items share a key, their hits are compared with both.
    """
    texts = items.select("_key", "_words").distinct()
    spread = texts.select("*", F.explode(F.sequence(F.lit(0), F.size("_words") - len(MASKS[0]))).alias("_at"))
    full = [F.when(F.col("_at") + max(m) < F.size("_words"), _seed("_words", "_at", k)) for k, m in enumerate(MASKS)]
    before = F.when(F.col("_at") > 0, F.get("_words", F.col("_at") - 1))
    return spread.select(F.explode(F.array(*full)).alias("_seed"), "_key", F.size("_words").alias("_length"), "_at",
                         before.alias("_before")).filter("_seed IS NOT NULL")


def _overlap(words: str | Column, item_words: str | Column) -> Column:
    """Struct (matched, stretch) of two aligned stretches of words."""
    equal = F.zip_with(words, item_words, lambda a, b: (a == b).cast("int"))
    start = F.struct(*[F.lit(0).alias(c) for c in ("all", "score", "run", "best", "stretch")])

    def step(s: Column, e: Column) -> Column:
        score = F.greatest(s["score"] + F.when(e == 1, 1).otherwise(-4), F.lit(0))
        run = F.when(score > 0, s["run"] + e).otherwise(0)
        return F.struct((s["all"] + e).alias("all"), score.alias("score"), run.alias("run"),
                        F.greatest(s["best"], score).alias("best"),
                        F.when(score > s["best"], run).otherwise(s["stretch"]).alias("stretch"))

    return F.aggregate(equal, start, step, lambda s: F.struct(s["all"].alias("matched"), s["stretch"].alias("stretch")))


def overlaps(documents: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, least_words: int = 8, passage_words: int = 13,
             broadcast_seeds: int = BROADCAST_SEEDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, item_id, matched_words, stretch_words, item_words) of every document passage that overlaps a benchmark item.

    ``matched_words`` are those at their places in the best alignment, ``stretch_words`` those of its best stretch.
    """
    items = benchmark_items(benchmark)
    seeds = benchmark_seeds(items)
    slices = max(1, -(-seeds.count() // broadcast_seeds))
    words = documents.select(*keys, word_hashes("text").alias("_words"))
    # An outer explode, for which the optimiser adds no filter that would split every text a second time.
    placed = words.select("*", F.explode_outer(F.when(F.size("_words") >= len(MASKS[0]), F.sequence(F.lit(0), F.size("_words") - len(MASKS[0])))).alias("_i"))
    placed = placed.filter("_i IS NOT NULL").select("*", F.explode(F.array(*[_seed("_words", "_i", k) for k in range(len(MASKS))])).alias("_s"))
    found = []
    for k in range(slices):
        part, sought = (seeds, placed) if slices == 1 else (
            seeds.filter(F.pmod("_seed", F.lit(slices)) == k), placed.filter(F.pmod("_s", F.lit(slices)) == k))
        leftmost = F.col("_before").isNull() | (F.col("_i") == 0) | (F.get("_words", F.col("_i") - 1) != F.col("_before"))
        hits = sought.join(F.broadcast(part), (F.col("_s") == F.col("_seed")) & leftmost)
        shift = F.col("_i") - F.col("_at")
        first = F.greatest(F.lit(0), -shift)
        length = F.least(F.col("_length"), F.size("_words") - shift) - first
        found.append(hits.select(
            *keys, "_key", first.alias("_first"), F.slice("_words", first + shift + 1, length).alias("_here"), F.spark_partition_id().alias("_task")))
    known = items.select("_key", F.col("_item").alias("item_id"), F.size("_words").alias("item_words"), F.col("_words").alias("_item_words"))
    hits = reduce(DataFrame.unionByName, found).join(known, "_key")
    there = F.slice("_item_words", F.col("_first") + 1, F.size("_here"))
    judged = hits.select(*keys, "item_id", "item_words", "_task", _overlap("_here", there).alias("o"))
    enough = ((F.col("o.matched") >= F.ceil(F.col("item_words") * similarity - 1e-9)) | (F.col("o.stretch") >= passage_words)
              | ((F.col("o.stretch") >= least_words) & (2 * F.col("o.stretch") >= F.col("item_words"))))
    # The task's number is not deterministic to the optimiser, which so leaves this filter above the join: inside the join, its lambdas would end
    # the generated code there, and each position of a text would be copied out with all of its words.
    enough = enough & (F.col("_task") >= 0)
    return (judged.filter(enough).groupBy(*keys, "item_id")
            .agg(F.max("o.matched").cast("bigint").alias("matched_words"), F.max("o.stretch").cast("bigint").alias("stretch_words"),
                 F.max("item_words").cast("bigint").alias("item_words")))


def keep_clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that overlap no benchmark item, columns unchanged.

    A document is known here by the digest of its text, so rows with repeated or missing ids are judged by their own texts.
    """
    key = fresh(documents, "_digest")
    digest = F.md5(text_or_empty("text"))
    leaking = overlaps(documents.select("text", digest.alias(key)), benchmark, keys=(key,), **options).select(key).distinct()
    return documents.withColumn(key, digest).join(leaking, key, "left_anti").select(*documents.columns)
