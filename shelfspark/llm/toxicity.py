"""Toxicity: a small convolutional text classifier over hashed word embeddings.

Words are runs of letters and digits, lower-cased. A word's embedding is the sum of the rows its hash and the hashes of its
first 4, 5 and 6 bytes point to, so that inflected and made-up forms share rows. Filters of several widths slide over the words; each
keeps its largest answer over the whole text (max pooling), and a logistic layer turns those into a score. The log-odds
that the network starts from are counted over all labelled documents outside the held-out fold. Its gradient steps run over all of them too, in slices side
by side: each epoch starts every slice from the same weights, and the steps of the slices are averaged. Decision thresholds are calibrated by
language on a part of the labelled documents that training has not seen.

Defined cases: a null or wordless text pools to zeros and gets the score of the bias alone; repeated documents get equal scores; a label
that is null is ignored, and a document labelled both ways counts as toxic; with no label of one class, the score is the
smoothed share of toxic labels; an empty table gives an empty table. Input columns are passed through unchanged.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfspark.llm.common import PIECE_BYTES, fresh, text_or_empty
from shelfspark.session import materialize

WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
#: Documents of a slice of the training, about; with more than ``SLICES`` of them, slices grow instead.
SLICE_DOCUMENTS, SLICES = 4000, 64
#: Words whose answers are held at once in training, and steps of a score between which thresholds may lie.
BLOCK_WORDS, SCORE_STEPS = 1 << 16, 10_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class ToxicityModel:
    """Weights. ``embedding`` has one more row than ``buckets``: the last is zero and stands for "nothing"."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.7

    @property
    def buckets(self) -> int:
        return len(self.embedding) - 1


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Bucket numbers of the words of a text, by differences of one running polynomial hash."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.powers = self.inverse = np.empty(0, dtype=np.uint64)

    def _piece(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(raw) + 1 > len(self.powers):
            n = max(2 * len(raw), 1 << 12)
            self.powers, self.inverse = _powers(n, _BASE), _powers(n, _INVERSE)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = _WORD[raw]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        running = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:len(raw)], out=running[1:])
        first, back = running[starts], self.inverse[starts]
        ids = np.full((len(starts), 1 + len(PREFIXES)), self.buckets, dtype=np.int32)
        for k, length in enumerate((0, *PREFIXES)):
            long_enough = ends - starts >= length
            stop = ends if not length else np.minimum(ends, starts + length)
            h = ((running[stop] - first) * back) ^ _SALTS[k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            ids[:, k] = np.where(long_enough, (h % np.uint64(self.buckets)).astype(np.int32), self.buckets)
        return ids

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """Word features of the whole text, piece by piece."""
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        start = 0
        while start < len(data):
            end = min(len(data), start + PIECE_BYTES)
            while end < len(data) and _WORD[data[end]]:
                end += 1
            yield self._piece(data[start:end])
            start = end


def _embed(embedding: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Word embeddings, one column a word."""
    x = embedding.take(ids[:, 0], axis=0)
    for k in range(1, ids.shape[1]):
        x += embedding.take(ids[:, k], axis=0)
    return np.ascontiguousarray(x.T)


def _answers(x: np.ndarray, filters: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each width, the answers of its filters (rows) at the first ``n`` words (columns)."""
    parts = iter(np.split(np.concatenate([w[k].T for w in filters for k in range(len(w))]) @ x,
                          np.cumsum([w.shape[2] for w in filters for _ in range(len(w))])[:-1]))
    out = []
    for w in filters:
        total = next(parts)[:, :n]
        for k in range(1, len(w)):
            total = total + next(parts)[:, k:n + k]
        out.append(total)
    return out


def _pool(model: ToxicityModel, blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """Largest answer of each filter over all windows of all words; a window may reach over the end into zeros."""
    reach = max(WIDTHS) - 1
    best: np.ndarray | None = None
    held = np.empty((0, 1 + len(PREFIXES)), dtype=np.int32)
    nothing = np.full((reach, held.shape[1]), model.buckets, dtype=np.int32)
    blocks = iter(blocks)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        ids = np.concatenate([held, block] if following is not None else [held, block, nothing])
        n = len(ids) - reach
        if n > 0:
            now = np.concatenate([a.max(axis=1) for a in _answers(_embed(model.embedding, ids), model.filters, n)])
            best = now if best is None else np.maximum(best, now)
        held = ids[max(n, 0):]
        block = following
    return best


def score_text(model: ToxicityModel, hasher: WordHasher, text: str | None) -> float:
    pooled = _pool(model, hasher.pieces(text))
    logit = model.bias + (0.0 if pooled is None else float(np.tanh(pooled) @ model.weights))
    return float(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))


@dataclass
class _Descent:
    """A model under training and its Adagrad sums; ``known`` are the embedding rows that may move."""

    model: ToxicityModel
    known: np.ndarray
    balance: tuple[float, float]
    g_embedding: np.ndarray
    g_filters: list[np.ndarray]
    g_weights: np.ndarray
    g_bias: float = 1e-1

    def dense(self) -> list[np.ndarray]:
        """Everything but the embedding, in a fixed order."""
        return [*self.model.filters, self.model.weights, np.array([self.model.bias]), *self.g_filters, self.g_weights, np.array([self.g_bias])]

    def add(self, dense: np.ndarray, rows: np.ndarray, steps: np.ndarray) -> None:
        """Move by the steps of :meth:`dense`, flat, and of embedding rows, whose last column is their Adagrad sum."""
        at, moved = 0, []
        for part in self.dense():
            moved.append((part + dense[at:at + part.size].reshape(part.shape)).astype(part.dtype))
            at += part.size
        n = len(WIDTHS)
        self.model.filters, self.model.weights, self.model.bias = moved[:n], moved[n], float(moved[n + 1][0])
        self.g_filters, self.g_weights, self.g_bias = moved[n + 2:2 * n + 2], moved[2 * n + 2], float(moved[2 * n + 3][0])
        self.model.embedding[rows] += steps[:, :-1]
        self.g_embedding[rows, 0] += steps[:, -1]


def _features(hasher: WordHasher, text: str | None) -> np.ndarray:
    return np.concatenate([*hasher.pieces(text), np.full((max(WIDTHS) - 1, 1 + len(PREFIXES)), hasher.buckets, dtype=np.int32)])


def _start(seen: np.ndarray, toxic: float, clean: float, rng: np.random.Generator, buckets: int, dim: int, n_filters: int, least_documents: int) -> _Descent:
    """The network before its first step. ``seen`` (2, buckets + 1) counts the clean and the toxic documents that hold a bucket.

    The first embedding axis starts as the shrunk log-odds of a bucket's document counts and the first filter of each width reads it;
    everything else starts small and random. Rows seen in fewer than ``least_documents`` texts stay zero, so that words
    unknown to the labelled documents say nothing.
    """
    embedding = np.zeros((buckets + 1, dim), dtype=np.float32)
    filters = [(rng.normal(size=(w, dim, n_filters)) * 0.3).astype(np.float32) for w in WIDTHS]
    model = ToxicityModel(embedding, filters, np.zeros(len(WIDTHS) * n_filters), float(np.log((toxic + 0.5) / (clean + 0.5))))
    known = np.zeros(buckets + 1, dtype=bool)
    balance = 1.0, 1.0
    if toxic and clean:
        total = seen.sum(axis=0)
        odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
        known = total >= least_documents
        known[buckets] = False
        embedding[:, 0] = np.where(known, 0.5 * odds * total / (total + 3), 0)
        embedding[:, 1:] = np.where(known[:, None], rng.normal(size=(buckets + 1, dim - 1)) * 0.02, 0)
        for w in filters:
            w[:, :, 0] *= 0.1
            w[:, 0, 0] = 0.5 / len(w)
        model.weights[::n_filters] = 1.0
        balance = 0.5 * (toxic + clean) / clean, 0.5 * (toxic + clean) / toxic
    return _Descent(model, known, balance, np.full((buckets + 1, 1), 1e-2, dtype=np.float32),
                    [np.full_like(w, 1e-1) for w in filters], np.full_like(model.weights, 1e-1))


def _winners(model: ToxicityModel, ids: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest answer of each filter over the first ``n`` words and, for each width, the windows that gave them; the first of equal ones."""
    best, where, reach = None, [], max(WIDTHS) - 1
    for start in range(0, n, BLOCK_WORDS):
        stop = min(n, start + BLOCK_WORDS)
        answers = _answers(_embed(model.embedding, ids[start:stop + reach]), model.filters, stop - start)
        now, at = [a.max(axis=1) for a in answers], [a.argmax(axis=1) + start for a in answers]
        if best is not None:
            at = [np.where(m > b, p, w) for m, b, p, w in zip(now, best, at, where, strict=True)]
            now = [np.maximum(m, b) for m, b in zip(now, best, strict=True)]
        best, where = now, at
    return np.concatenate(best), where


def _descend(state: _Descent, ids: np.ndarray, label: int, rate: float) -> np.ndarray:
    """One Adagrad step for a document; only the winning window of a filter has a gradient. Returns the embedding rows moved."""
    model, known = state.model, state.known
    n = len(ids) - (max(WIDTHS) - 1)
    if n < 1:
        return np.empty(0, np.int32)
    pooled, where = _winners(model, ids, n)
    pooled = np.tanh(pooled)
    error = state.balance[label] * (1 / (1 + np.exp(-np.clip(model.bias + pooled @ model.weights, -30, 30))) - label)
    if abs(error) < 1e-3:
        return np.empty(0, np.int32)
    back = error * model.weights * (1 - pooled ** 2)
    step = error * pooled + 1e-4 * model.weights
    state.g_weights += step ** 2
    model.weights -= rate * step / np.sqrt(state.g_weights)
    state.g_bias += error ** 2
    model.bias -= rate * error / np.sqrt(state.g_bias)
    moved = []
    read = [[_embed(model.embedding, ids[where[j] + k]) for k in range(len(w))] for j, w in enumerate(model.filters)]
    for j, w in enumerate(model.filters):
        n_filters = w.shape[2]
        d = back[j * n_filters:(j + 1) * n_filters].astype(np.float32)
        for k in range(len(w)):
            rows = where[j] + k
            step_e = w[k].T * d[:, None]
            for row, s in zip(ids[rows], step_e, strict=True):
                row = row[known[row]]
                state.g_embedding[row] += (s ** 2).mean()
                model.embedding[row] -= rate * s / np.sqrt(state.g_embedding[row])
                moved.append(row)
            step_w = read[j][k] * d[None, :]
            state.g_filters[j][k] += step_w ** 2
            w[k] -= rate * step_w / np.sqrt(state.g_filters[j][k])
    return np.concatenate(moved)


def train(texts: list[str], labels: np.ndarray, *, buckets: int = 1 << 16, dim: int = 8, n_filters: int = 6, epochs: int = 2,
          rate: float = 0.05, least_documents: int = 3, seed: int = 7) -> ToxicityModel:
    """Weights from labelled texts in memory; :func:`train_slices` is the same over a table."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.int64)
    hasher = WordHasher(buckets)
    features = [_features(hasher, t) for t in texts]
    seen = np.zeros((2, buckets + 1))
    for ids, label in zip(features, labels, strict=True):
        seen[label, np.unique(ids)] += 1
    toxic = float(labels.sum())
    state = _start(seen, toxic, len(labels) - toxic, rng, buckets, dim, n_filters, least_documents)
    for _ in range(epochs if 0 < toxic < len(labels) else 0):
        for i in rng.permutation(len(features)):
            _descend(state, features[i], int(labels[i]), rate)
    return state.model


def _bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """(2, buckets + 1): the clean and the toxic documents that hold a bucket, over all rows; as many numbers come back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(buckets), np.zeros((2, buckets + 1), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                seen[label, np.unique(_features(hasher, text.as_py()))] += 1
        held = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[0, held]), pa.array(seen[1, held])], names=["row", "clean", "toxic"])

    counted = rows.select("text", "toxic").mapInArrow(count, "row int, clean bigint, toxic bigint")
    found = counted.groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    seen = np.zeros((2, buckets + 1))
    seen[:, found["row"].to_numpy(dtype=np.int64)] = found[["clean", "toxic"]].to_numpy(dtype=np.float64).T
    return seen


def train_slices(rows: DataFrame, *, buckets: int = 1 << 16, dim: int = 8, n_filters: int = 6, epochs: int = 2,
                 rate: float = 0.05, least_documents: int = 3, seed: int = 7) -> ToxicityModel:
    """Weights from all rows (_id, _h, text, toxic).

    Documents are dealt into slices by the hash ``_h``, and ordered in them by a hash of epoch and id, so the model does not depend on how the table is laid
    out. In an epoch each slice takes a step per document from where all of them started; what comes back is the mean step of each number over
    the slices that moved it, of which there are as many as the model has numbers.
    """
    number = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = (float(number.get(label, 0)) for label in (1, 0))
    learns = bool(toxic and clean)
    seen = _bucket_counts(rows, buckets) if learns else np.zeros((2, buckets + 1))
    state = _start(seen, toxic, clean, np.random.default_rng(seed), buckets, dim, n_filters, least_documents)
    slices = min(SLICES, -(-int(toxic + clean) // SLICE_DOCUMENTS))
    columns = [f"d{i}" for i in range(dim + 1)]
    context = rows.sparkSession.sparkContext
    for epoch in range(epochs if learns else 0):
        held = context.broadcast(state)

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared = held.value
            own, hasher, moved = copy.deepcopy(shared), WordHasher(buckets), np.zeros(buckets + 1, dtype=bool)
            n = 0
            for batch in batches:
                for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                    moved[_descend(own, _features(hasher, text.as_py()), label, rate)] = True
                    n += 1
            if not n:
                return
            places = np.flatnonzero(moved)
            steps = np.hstack([own.model.embedding[places].astype(np.float64) - shared.model.embedding[places],
                               own.g_embedding[places].astype(np.float64) - shared.g_embedding[places]])
            dense = np.concatenate([(np.asarray(a, dtype=np.float64) - b).ravel() for a, b in zip(own.dense(), shared.dense(), strict=True)])
            table = np.vstack([steps, np.hstack([dense[:, None], np.zeros((len(dense), dim))])])
            at = np.concatenate([places, buckets + 1 + np.arange(len(dense))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(c)) for c in table.T]], names=["row", *columns])

        dealt = rows.repartition(slices, "_h").sortWithinPartitions(F.xxhash64(F.lit(epoch), "_id"), "_id").select("text", "toxic")
        steps = dealt.mapInArrow(descend, "row int, " + ", ".join(f"{c} double" for c in columns))
        found = steps.groupBy("row").agg(*[F.avg(c).alias(c) for c in columns]).toPandas().sort_values("row")
        embedded = found["row"] <= buckets
        state.add(found.loc[~embedded, "d0"].to_numpy(), found.loc[embedded, "row"].to_numpy(), found.loc[embedded, columns].to_numpy())
        held.unpersist()
    return state.model


def best_threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray, default: float, least: float = 0.5) -> float:
    """The cut with the fewest errors, in the middle of the widest gap of scores that has them; never below ``least``.

    Scores come in ascending steps: the least and greatest of each, and its toxic and clean documents. A cut lies between steps.
    """
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    below, above = np.concatenate([[0.0], high]), np.concatenate([low, [1.0]])
    cuts, gaps = (below + above) / 2, above - below
    open_gap = gaps > 0
    if not open_gap.any():
        return default
    fewest = errors[open_gap].min()
    among = np.flatnonzero(open_gap & (errors == fewest))
    return float(max(least, cuts[among[np.argmax(gaps[among])]]))


def calibrate(model: ToxicityModel, rows: DataFrame, least_per_class: int = 15) -> None:
    """Set a threshold for each language with enough labels of both classes, from all rows (text, lang, toxic); others keep the default.

    Scores are counted in ``SCORE_STEPS`` steps, so no more numbers than that come back for a language.
    """
    scored = score(rows.select("text", "lang", "toxic"), model, "_score")
    steps = (scored.filter("lang <> ''").groupBy("lang", F.floor(F.col("_score") * SCORE_STEPS).alias("step"))
             .agg(F.min("_score").alias("low"), F.max("_score").alias("high"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))
    for lang, own in steps.toPandas().sort_values(["lang", "step"]).groupby("lang"):
        if min(own["toxic"].sum(), own["clean"].sum()) >= least_per_class:
            model.thresholds[lang] = best_threshold(*[own[c].to_numpy() for c in ("low", "high", "toxic", "clean")], model.default_threshold)


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never read: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, text, lang, toxic) of all labelled documents outside the held-out fold, whatever their length."""
    marked = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    return (documents.select(F.col("doc_id").alias("_id"), text_or_empty("text").alias("text"), F.col("lang").cast("string").alias("lang"))
            .join(marked, "_id").dropDuplicates(["_id"]))


def fit(documents: DataFrame, labels: DataFrame, *, calibration: int = 5, **training) -> ToxicityModel:
    """Train on all labelled documents outside the held-out fold; every ``calibration``-th of them, by hash, only sets the thresholds."""
    rows = materialize(labelled(documents, labels).withColumn("_h", F.xxhash64(F.lit("fold"), "_id")), "labelled")
    apart = F.col("_h") % calibration == 0
    model = train_slices(rows.filter(~apart), **training)
    calibrate(model, rows.filter(apart))
    return model


def score(documents: DataFrame, model: ToxicityModel, score_col: str = "score", flag_col: str | None = None) -> DataFrame:
    """``documents`` with the score of each whole text; with ``flag_col`` also whether it reaches its language's threshold."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # its size is set by buckets and dim
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        hasher = WordHasher(model.buckets)
        for batch in batches:
            scores = pa.array([score_text(model, hasher, t.as_py()) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score_col])

    schema = StructType([*documents.schema.fields, StructField(score_col, DoubleType(), False)])
    scored = documents.mapInArrow(run, schema)
    if flag_col is None:
        return scored
    cuts = F.lit(model.default_threshold)
    for lang, cut in model.thresholds.items():
        cuts = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(cuts)
    return scored.withColumn(flag_col, F.col(score_col) >= cuts)


def keep_clean(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents below their language's threshold, columns unchanged."""
    mark, flag = fresh(documents, "_toxicity"), fresh(documents, "_toxic")
    return score(documents, model, mark, flag).filter(~F.col(flag)).select(*documents.columns)
