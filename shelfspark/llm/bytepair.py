"""Byte-level BPE by dynamic programming over prefixes.

The merge rules give every byte string one encoding, and a sequence of tokens is that encoding exactly if each neighbouring pair
of tokens is the encoding of its own bytes. So every prefix of a piece has one valid last token: the one token ending there that
may follow the last token of the prefix in front of it. A table of these last tokens is all that is kept: reading it backwards gives the
encoding of any prefix, appending bytes only adds entries, and after an edit the entries in front of it still hold.

Defined cases: a null text counts as empty; an empty text has no tokens; ids outside the vocabulary raise an error when decoded;
texts of any length are encoded whole, in stretches cut where the split pattern always ends a piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Pieces whose encodings a task remembers, and pairs it remembers as valid or not; beyond, it forgets and starts again.
MEMO_PIECES, MEMO_PAIRS = 900_000, 500_000
_STRETCH = 1 << 18
_CUT = regex.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


class Memo:
    """A dictionary of bounded size: when it is full, its older half is forgotten, but for what was asked for since."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Vocabulary:
    """Tokens and their ranks, from the text of a rank file (base64 token, space, rank on each line)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.numbers = {rank: str(rank) for rank in self.tokens}
        #: One number object a token, shared by all encodings that are remembered.
        self.shared = {rank: rank for rank in self.tokens}
        #: Trie of the tokens read backwards; a node is (token that ends with it, or -1, and its children by byte). A token that is not the
        #: encoding of its own bytes occurs in no encoding and is left out.
        self.backwards: dict = {}
        for token, rank in self.ranks.items():
            if len(self._merged(token)) == 1:
                children = self.backwards
                for byte in token[:0:-1]:
                    children = children.setdefault(byte, (-1, {}))[1]
                children[token[0]] = (rank, children[token[0]][1] if token[0] in children else {})
        #: Whether two tokens are the encoding of their joined bytes.
        self.pairs = Memo(MEMO_PAIRS)

    def _merged(self, data: bytes) -> list[bytes]:
        """Encoding of a short byte string by its definition: the pair of lowest rank is merged first, the leftmost of equals."""
        ranks, parts = self.ranks, [data[k:k + 1] for k in range(len(data))]
        found = [ranks.get(data[k:k + 2]) for k in range(len(data) - 1)]
        while True:
            best, at = None, -1
            for k, rank in enumerate(found):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                return parts
            parts[at:at + 2] = [joined := parts[at] + parts[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(joined + parts[at + 1])
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + joined)

    def may_follow(self, left: int, right: int) -> bool:
        known = self.pairs.get(key := (left << 32) | right)
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            known = self._merged(a + b) == [a, b]
            self.pairs.put(key, known)
        return known

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The valid last token of each prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = array("q", [-1])
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the piece; entries so far stay."""
        backwards, may_follow, last = self.vocabulary.backwards, self.vocabulary.may_follow, self.last
        pairs = self.vocabulary.pairs
        start = len(self.data)
        self.data = data = self.data + more
        for end in range(start + 1, len(data) + 1):
            children, begin, known = backwards, end - 1, pairs.young.get
            while begin >= 0 and (node := children.get(data[begin])) is not None:
                token, children = node
                if token >= 0:
                    if not begin:
                        last.append(token)
                        break
                    before = last[begin]
                    valid = known((before << 32) | token)
                    if valid or valid is None and may_follow(before, token):
                        last.append(token)
                        break
                begin -= 1
            else:
                raise ValueError(f"no token of the vocabulary covers byte {data[end - 1]}")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Re-encode after an edit of bytes ``start`` to ``end``: entries up to ``start`` are kept."""
        rest = new + self.data[end:]
        self.data = self.data[:start]
        del self.last[start + 1:]
        self.append(rest)

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the prefix of ``end`` bytes (all of them without it)."""
        at, out = len(self.data) if end is None else end, []
        shared, tokens = self.vocabulary.shared, self.vocabulary.tokens
        while at:
            token = self.last[at]
            out.append(shared[token])
            at -= len(tokens[token])
        return out[::-1]


class Encoder:
    """Encodes texts; each match of ``pattern`` is a piece of its own. A piece that is a token is that token."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        # White space as Unicode defines it: the module's own class also holds four control characters.
        # Possessive runs match the same here, and faster: what may follow a run of a class is never of that class.
        spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaces.replace(r"\p{L}+", r"\p{L}++").replace(r"\p{N}+", r"\p{N}++").replace(r"\p{N}]+", r"\p{N}]++"))
        self.memo = Memo(MEMO_PIECES)

    def piece(self, text: str) -> tuple[int, ...]:
        known = self.memo.get(text)
        if known is None:
            data = text.encode("utf-8")
            whole = self.vocabulary.ranks.get(data)
            known = (whole,) if whole is not None else tuple(PrefixTable(self.vocabulary, data).ids())
            if len(data) <= 256:
                self.memo.put(text, known)
        return known

    def _pieces(self, texts: list[str]) -> Iterator[tuple[int, ...]]:
        piece, memo = self.piece, self.memo
        for text in texts:
            yield memo.young.get(text) or piece(text)

    def stretches(self, text: str) -> Iterator[list[int]]:
        """Token ids of a whole text, a stretch of it at a time."""
        start = 0
        while start < len(text):
            cut = _CUT.search(text, start + _STRETCH) if len(text) - start > _STRETCH else None
            end = cut.start() if cut else len(text)
            yield list(chain.from_iterable(self._pieces(self.pattern.findall(text[start:end]))))
            start = end

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.stretches(text or "")))


class EditableText:
    """A text with its pieces' prefix tables; appends and edits re-encode only the pieces they touch."""

    #: Characters behind a piece that can decide where it ends.
    _AHEAD = 3

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        #: Prefix tables made or extended so far, for tests and figures.
        self.touched = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        old_text, old_starts, old_tables = self.text, self.starts, self.tables
        self.text = text = old_text[:start] + new + old_text[end:]
        shift = len(text) - len(old_text)
        ends = [*old_starts[1:], len(old_text)]
        kept = 0
        while kept < len(old_starts) and ends[kept] + self._AHEAD <= start:
            kept += 1
        at = old_starts[kept] if kept < len(old_starts) else len(old_text) if kept else 0
        self.starts, self.tables = old_starts[:kept], old_tables[:kept]
        old_at = {s: k for k, s in enumerate(old_starts)}
        while at < len(text):
            same = old_at.get(at - shift)
            if same is not None and at - shift >= end:  # from here on, nothing has changed
                self.starts += [s + shift for s in old_starts[same:]]
                self.tables += old_tables[same:]
                return
            match = self.encoder.pattern.match(text, at)
            self.starts.append(at)
            self.tables.append(self._table(old_tables[old_at[at]] if at < start and at in old_at else None, match.group().encode("utf-8")))
            at = match.end()

    def _table(self, old: PrefixTable | None, data: bytes) -> PrefixTable:
        if old is not None and old.data == data:
            return old
        self.touched += 1
        if old is None:
            return PrefixTable(self.encoder.vocabulary, data)
        common = next((k for k, (a, b) in enumerate(zip(old.data, data, strict=False)) if a != b), min(len(old.data), len(data)))
        old.replace(common, len(old.data), data[common:])
        return old

    def ids(self) -> list[int]:
        ranks = self.encoder.vocabulary.ranks
        out: list[int] = []
        for table in self.tables:
            whole = ranks.get(table.data)
            out.extend([whole] if whole is not None else table.ids())
        return out


def _shipped(spark: SparkSession, ranks_path: str, pattern: str):
    """Broadcast of a vocabulary file, whose size no table decides; a worker keeps the encoder it makes of it from task to task."""
    with open(ranks_path, "rb") as file:
        held = spark.sparkContext.broadcast({"ranks": file.read(), "pattern": pattern})

    def encoder() -> Encoder:
        kept = held.value
        if "encoder" not in kept:
            kept["encoder"] = Encoder(Vocabulary(kept["ranks"]), kept["pattern"])
        return kept["encoder"]

    return encoder


def tokens(documents: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """``documents`` with the token ids of each whole text. Ids are below 2^31."""
    made, text = _shipped(documents.sparkSession, ranks_path, pattern), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                ids = pa.array([encoder.encode(t.as_py()) for t in rows.column(text)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*rows.schema.names, ids_col])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(ids_col, ArrayType(IntegerType(), False), False)]))


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids in decimal joined by spaces, digest of the decoded bytes."""
    narrow = documents.select("doc_id", "text")
    made = _shipped(documents.sparkSession, ranks_path, pattern)
    schema = StructType([narrow.schema[0], StructField("n_tokens", LongType(), False), StructField("ids_sha256", StringType(), False),
                         StructField("decoded_sha256", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made()
        vocabulary = encoder.vocabulary
        number = vocabulary.numbers.__getitem__
        for batch in batches:
            counts, ids_digests, decoded_digests = [], [], []
            for value in batch.column(1):
                n, ids_digest, decoded_digest = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.stretches(value.as_py() or ""):
                    ids_digest.update((" " * bool(n and ids) + " ".join(map(number, ids))).encode())
                    decoded_digest.update(vocabulary.decode(ids))
                    n += len(ids)
                counts.append(n)
                ids_digests.append(ids_digest.hexdigest())
                decoded_digests.append(decoded_digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                                              pa.array(decoded_digests, pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def decoded(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids", text_col: str = "decoded_text") -> DataFrame:
    """``encoded`` with the text its ids stand for; bytes that are no UTF-8 become replacement characters."""
    made, at = _shipped(encoded.sparkSession, ranks_path, ""), encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = made().vocabulary
        for batch in batches:
            texts = [None if ids.as_py() is None else vocabulary.decode(ids.as_py()).decode("utf-8", "replace") for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(text_col, StringType(), True)]))
