"""Importance resampling towards a target distribution.

Features are the runs of one to ``longest`` consecutive words, hashed to buckets. A bucket's gain is the scaled logarithm of how much likelier the
target makes it than the documents do; a document's weight is the sum of its features' gains, its score the weight and Gumbel noise drawn from its id,
so that the highest scores are a sample without replacement. Two passes over the texts: the first counts features of all documents
and of all target texts into arrays of a fixed number of buckets, the second adds up the array of gains. The k highest scores are
found by a distributed quickselect over a written table of scores: a few rows drawn at random give pivot keys (score, id, features), one exact count
of the rows below, at and above each leaves the rows between two pivots, and so on until the k-th key is a pivot. Only rows up to that key are sorted and ranked.

Defined cases: a null text has no words; a text without words has weight 0; documents below ``min_words`` are scored, never drawn; a null id is drawn by the hash of
an empty id and comes before all others in ties; rows of equal score and id go by the smaller number of features, rows equal in that as well in any order; an empty
table gives an empty table; an empty target has count 0 everywhere. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfspark.llm.common import fresh, pieces
from shelfspark.operators.ranking import rank_in_group
from shelfspark.session import materialize

#: Pivots of a round of the quickselect: so many rows at most reach the driver, and a round leaves about a sixteenth of them.
PIVOTS = 15
#: All bytes but digits, ASCII letters and those of other characters are spaces; A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def feature_hashes(text: str | None, longest: int = 3, piece: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """Stretch by stretch, the number of words and the CRC-32 of each run of 1 to ``longest`` words ending in the stretch.

    A sum over a run's bytes is carried on: that of the run without its last word goes in where the last word is added.
    """
    tail: list[int] = []  # hashes of the runs that end with the last word so far, by length
    for data in pieces((text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES), b" ", piece):
        words = data.split()
        if not words:
            continue
        spaced = [b" " + w for w in words]
        last = list(map(crc32, words))
        found, ends = [last], [last[-1]]
        for k in range(1, longest):
            # Runs of k words that end in front of each word: the last of the stretch before, then those of this one.
            before = [*tail[k - 1:k], *last[:-1]]
            last = list(map(crc32, spaced[len(spaced) - len(before):], before))
            found.append(last)
            if not last:
                break
            ends.append(last[-1])
        tail = ends
        yield len(words), np.fromiter(chain.from_iterable(found), dtype=np.int64)


def feature_counts(texts: DataFrame, text: str = "text", *, buckets: int = 10_000, longest: int = 3) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks add up arrays, the driver gets one number a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, hashes in feature_hashes(value.as_py(), longest):
                    total += np.bincount(hashes % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the target's smoothed share of a bucket over the source's), for each bucket."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((float(t) + 1) * (all_source + n) / ((float(s) + 1) * (all_target + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id, seed: int = 42, scale: int = 1000) -> int:
    """Gumbel noise of an id, the same in every run."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


@dataclass(frozen=True)
class Weights:
    """What turns a text and an id into a score."""

    gains: np.ndarray
    longest: int = 3
    seed: int = 42

    def weigh(self, text: str | None) -> tuple[int, int, int]:
        """(words, features, weight) of a whole text."""
        words = features = weight = 0
        for n, hashes in feature_hashes(text, self.longest):
            words, features = words + n, features + len(hashes)
            weight += int(self.gains[hashes % len(self.gains)].sum())
        return words, features, weight


def fit(documents: DataFrame, target: DataFrame, *, buckets: int = 10_000, longest: int = 3, seed: int = 42) -> Weights:
    """Weights from all texts of both tables (column ``text``)."""
    count = partial(feature_counts, buckets=buckets, longest=longest)
    return Weights(gains(count(documents), count(target)), longest, seed)


SCORED = ("n_words", "n_features", "weight", "score")


def score(documents: DataFrame, weights: Weights, names: Sequence[str] = SCORED) -> DataFrame:
    """``documents`` (doc_id, text, …) with four long columns ``names``: words, features, weight and score."""
    doc_id, text = documents.columns.index("doc_id"), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((4, batch.num_rows), dtype=np.int64)
            for k in range(batch.num_rows):
                words, features, weight = weights.weigh(batch.column(text)[k].as_py())
                found[:, k] = words, features, weight, weight + noise(batch.column(doc_id)[k].as_py(), weights.seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, *names])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, *[StructField(n, LongType(), False) for n in names]]))


def kth_key(rows: DataFrame, key: Sequence[str], k: int, *, pivots: int = PIVOTS, seed: int = 42) -> tuple:
    """The k-th smallest composite ``key`` of ``rows`` (1-based; nulls are smallest), by quickselect. ``rows`` is best a written table.

    Each round draws up to ``pivots`` distinct keys at random, counts the rows below and at each of them exactly, and goes on with the rows between two
    pivots, written to a table of their own. A key that many rows share is dealt with as soon as it is drawn, however many they are.
    """
    current = rows.select(*key)
    this = F.struct(*key)
    types = [current.schema[c].dataType for c in key]
    order = [F.col(c).asc_nulls_first() for c in key]

    def fixed(pivot: tuple):
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(pivot, types, key, strict=True)])

    turn = 0
    while True:
        drawn = current.orderBy(F.xxhash64(F.lit(seed + turn), *key)).limit(pivots).distinct().orderBy(*order).collect()
        if not drawn:
            raise ValueError("k exceeds the number of rows")
        cuts = [fixed(tuple(row)) for row in drawn]
        counts = current.agg(*[F.count_if(this < c) for c in cuts], *[F.count_if(this == c) for c in cuts]).first()
        below, at = counts[:len(cuts)], counts[len(cuts):]
        for row, n_below, n_at in zip(drawn, below, at, strict=True):
            if n_below < k <= n_below + n_at:
                return tuple(row)
        left = max((j for j in range(len(cuts)) if below[j] + at[j] < k), default=None)
        right = min((j for j in range(len(cuts)) if below[j] >= k), default=None)
        if left is not None:
            current, k = current.filter(this > cuts[left]), k - below[left] - at[left]
        if right is not None:
            current = current.filter(this < cuts[right])
        current = materialize(current, "quickselect")
        turn += 1


def _keyed(scored: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    first = fresh(scored, "_first")
    return scored.withColumn(first, -F.col(names[3])), [first, "doc_id", names[1]]


def threshold(scored: DataFrame, *, percent: int = 5, min_words: int = 20, names: Sequence[str] = SCORED) -> tuple[int, tuple | None]:
    """How many rows are drawn, floor(percent/100) of those with at least ``min_words`` words, and the composite key of the last of them.

    ``scored`` should be a written table, for it is read several times.
    """
    keyed, key = _keyed(scored, names)
    eligible = keyed.filter(F.col(names[0]) >= min_words)
    k = eligible.count() * percent // 100
    return k, kth_key(eligible, key, k) if k else None


def draw(scored: DataFrame, k: int, last: tuple | None, *, min_words: int = 20, names: Sequence[str] = SCORED, rank_col: str = "rank") -> DataFrame:
    """``scored`` with the rank (from 1) of the ``k`` rows drawn, highest scores first; ``last`` is the key of the k-th (:func:`threshold`)."""
    none = F.lit(None).cast("bigint").alias(rank_col)
    if not k:
        return scored.select("*", none)
    keyed, key = _keyed(scored, names)
    bound = F.struct(*[F.lit(v).cast(keyed.schema[c].dataType).alias(c) for v, c in zip(last, key, strict=True)])
    within = (F.col(names[0]) >= min_words) & (F.struct(*key) <= bound)
    up_to = rank_in_group(keyed.filter(within), [], key, rank_col)
    up_to = up_to.select(*scored.columns, F.when(F.col(rank_col) <= k, F.col(rank_col)).alias(rank_col))
    return up_to.unionByName(keyed.filter(~within).select(*scored.columns, none))


def _scores(documents: DataFrame, target: DataFrame, seed: int, buckets: int, longest: int) -> tuple[Weights, DataFrame]:
    weights = fit(documents, target, buckets=buckets, longest=longest, seed=seed)
    return weights, materialize(score(documents.select("doc_id", "text"), weights).drop("text"), "scores")


def ranked(documents: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000,
           longest: int = 3) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``documents``; rank is null for those not drawn."""
    _, scored = _scores(documents, target, seed, buckets, longest)
    drawn = draw(scored, *threshold(scored, percent=percent, min_words=min_words), min_words=min_words)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def resample(documents: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000,
             longest: int = 3) -> DataFrame:
    """The documents drawn, whole and with their columns.

    The threshold is found on a narrow table of scores; then texts are scored once more, and only those up to the threshold are sorted.
    """
    weights, scored = _scores(documents, target, seed, buckets, longest)
    k, last = threshold(scored, percent=percent, min_words=min_words)
    names = [fresh(documents, f"_{name}") for name in SCORED]
    rank = fresh(documents, "_rank")
    chosen = draw(score(documents, weights, names), k, last, min_words=min_words, names=names, rank_col=rank)
    return chosen.filter(F.col(rank).isNotNull()).select(*documents.columns)
