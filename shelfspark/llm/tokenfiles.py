"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames of little-endian unsigned 32-bit ids, then the index of its documents in a skippable
frame, then a seek table in a last skippable frame: for each frame its compressed and decompressed size and the low half of the XXH64
of its content. A reader takes the two tables from the end of the file and then fetches, checks and decompresses only the frames
that hold the documents it is asked for. A frame holds a bounded number of ids; a longer document goes over several.

Documents lie in ascending doc_id order over the files of a set (null ids first, repeated ids in the order of a hash of their texts, equal
rows in any order). Null and empty texts have only the end id. An empty table gives an empty set of files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfspark.llm.bytepair import Memo
from shelfspark.llm.common import pieces, text_or_empty
from shelfspark.llm.files import opened, read_range, written
from shelfspark.session import materialize, scratch_path

FRAME_IDS = 1 << 18
MEMO_WORDS = 1_000_000
#: Fixed values of the seekable format.
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_HEAD, _ENTRY, _FOOTER = "<II", "<III", "<IBI"
_HEAD_BYTES, _ENTRY_BYTES, _FOOTER_BYTES = 8, 12, 9


#: The normalizer and the split of the tokenizers whose pieces are found without the library. Pieces are encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: The same split for words of ASCII, and for words with the letters U+00C0 to U+017F, which no normalization changes and which have lower forms of their own.
_VISIBLE = re.compile(rb"[!-~]+")
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Words longer than this are not remembered; pieces of one call; bytes of texts that are encoded together.
_MEMO_BYTES, _CALL_PIECES, _WINDOW = 256, 20_000, 8 << 20
_SPACE = b" \t\n\v\f\r"


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and whose tokens never reach over white space; words met before are looked up.

    Words not met before are cut into the pieces that the tokenizer would make of them, and pieces not met before are encoded by the library, many in a
    call. The last token of a piece says that it is the last, which tells the pieces apart again. Names of added tokens in a text are those tokens.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        added = {t["content"].encode("utf-8"): t for t in parts["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values()):
            raise ValueError("added tokens that are not plain names")
        self.added = {name: struct.pack("<I", t["id"]) for name, t in added.items()}
        self.names = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True  # what looks like a name after lower-casing is ordinary text
        self.bar = self.whole.encode("|", add_special_tokens=False).ids
        self.memo = Memo(MEMO_WORDS)
        self.bare = None
        suffix = parts["model"].get("end_of_word_suffix")
        if suffix and parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL]}:
            cut = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTE_LEVEL]}
            bare = parts | {"normalizer": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": cut}))
            self.visible = Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
            vocabulary = self.bare.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    def _pieces(self, word: bytes) -> list[bytes] | None:
        """What the tokenizer makes of a word before it merges; None where only the library can tell."""
        if word.isascii():
            return _ASCII_PIECES.findall(word)
        text = word.decode("utf-8")
        return [p.encode("utf-8") for p in _LATIN_PIECES.findall(text.lower())] if _LATIN.fullmatch(text) else None

    def _encoded(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Pieces with their ids. Visible ASCII stands for itself in the tokenizer's alphabet of bytes; others are translated by the library."""
        visible = [p for p in pieces if _VISIBLE.fullmatch(p)]
        for tokenizer, part in ((self.visible, visible), (self.bare, [p for p in pieces if not _VISIBLE.fullmatch(p)] if len(visible) < len(pieces) else [])):
            for start in range(0, len(part), _CALL_PIECES):
                call = part[start:start + _CALL_PIECES]
                ids = np.array(tokenizer.encode_batch_fast([b" ".join(call).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
                ends, data = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
                yield from zip(call, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True)

    def _odd(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words by the whole tokenizer, in one call: a bar between words gives an id that words without a bar do not have."""
        plain = [w for w in words if b"|" not in w] if len(self.bar) == 1 else []
        if plain:
            ids = np.array(self.whole.encode_batch_fast([b" | ".join(plain).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.bar[0]).tolist(), len(ids)]
            data, start = ids.tobytes(), 0
            for word, end in zip(plain, ends, strict=True):
                yield word, data[4 * start:4 * end]
                start = end + 1
        for word in words if not plain else [w for w in words if b"|" in w]:
            yield word, np.array(self.whole.encode(word.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _resolved(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words that the memo does not have."""
        new, several, odd, known = set(), [], [] if self.bare else words, {}
        for word in words if self.bare else ():
            pieces = self._pieces(word)
            if pieces is None:
                odd.append(word)
            elif pieces == [word]:
                new.add(word)
            else:
                several.append((word, pieces))
        for piece in {p for _, pieces in several for p in pieces}.difference(new):
            if (value := self.memo.get(piece)) is None:
                new.add(piece)
            else:
                known[piece] = value
        found = dict(self._encoded(list(new))) if new else {}
        found.update(self._odd(odd))
        known.update(found)
        for word, pieces in several:
            found[word] = known[word] = b"".join(map(known.__getitem__, pieces))
        for key, value in found.items():
            if len(key) <= _MEMO_BYTES:
                self.memo.put(key, value)
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without names of added tokens, one after the other, and where each text's begin (and the last one's end).

        Each distinct word of the texts is looked up once; what a word occurs for is gathered as arrays.
        """
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        words, at = _byte_strings(coded.dictionary), coded.indices.to_numpy()
        found = list(map(self.memo.young.get, words))
        gaps = [k for k, value in enumerate(found) if value is None]
        absent = []
        for k in gaps:
            if (value := self.memo.get(words[k])) is None:
                absent.append(words[k])
            else:
                found[k] = value
        known = self._resolved(absent)
        for k in gaps:
            if found[k] is None:
                found[k] = known[words[k]]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        ids, firsts = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        places = np.repeat(firsts[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])
        return ids[places], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def text(self, text: str | None, piece: int = 1 << 18) -> Iterator[bytes]:
        """Ids of a whole text, a stretch at a time."""
        data = (text or "").encode("utf-8")
        for k, part in enumerate(self.names.split(data) if self.names else [data]):
            if k % 2:
                yield self.added[part]
            else:
                for stretch in pieces(part, _SPACE, piece):
                    yield self.encode(pa.array([stretch.decode("utf-8")]))[0].tobytes()

    def texts(self, texts: pa.Array) -> Iterator[Iterable[bytes]]:
        """Ids of whole texts, each in blocks. Texts that are not very long share the lookups and the calls to the library."""
        alone = pc.greater(pc.binary_length(texts), _WINDOW)
        for name in self.added:
            alone = pc.or_(alone, pc.match_substring(texts, name.decode("utf-8")))
        ids, bounds = self.encode(texts.filter(pc.invert(alone)))
        k = 0
        for text, apart in zip(texts, alone.to_pylist(), strict=True):
            if apart:
                yield self.text(text.as_py())
            else:
                yield [ids[bounds[k]:bounds[k + 1]].tobytes()]
                k += 1


def _byte_strings(values: pa.StringArray) -> list[bytes]:
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[values.offset:values.offset + len(values) + 1].tolist() if len(values) else [0]
    data = data.to_pybytes() if data else b""
    return list(map(data.__getitem__, map(slice, at, at[1:])))


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive documents whose texts have about :data:`_WINDOW` bytes together, or one longer text."""
    for batch in batches:
        ends, start = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + _WINDOW, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class FileWriter:
    """Writes frames, document index and seek table to a stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.entries = bytearray(), []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, blocks: Iterable[bytes]) -> None:
        size = 0
        for block in blocks:
            size += len(block)
            self.held += block
            while len(self.held) >= self.frame_bytes:
                self._frame(bytes(self.held[:self.frame_bytes]))
                del self.held[:self.frame_bytes]
        self.doc_ids.append(doc_id)
        self.counts.append(size // 4)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self._write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def finish(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
            self.held.clear()
        missing = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        index = self.zstd.compress(missing.tobytes() + ids.tobytes() + np.array(self.counts, dtype="<i8").tobytes())
        self._write(struct.pack(_HEAD, _INDEX_MAGIC, len(index)) + index)
        self.entries.append((_HEAD_BYTES + len(index), 0, 0))
        table = b"".join(struct.pack(_ENTRY, *e) for e in self.entries)
        self._write(struct.pack(_HEAD, _SEEK_MAGIC, len(table) + _FOOTER_BYTES) + table + struct.pack(_FOOTER, len(self.entries), 0x80, _FOOTER_MAGIC))


@dataclass
class FileIndex:
    """Where the frames and documents of a file are."""

    offsets: np.ndarray  # of frames in the file
    sizes: np.ndarray  # compressed
    firsts: np.ndarray  # first id of each frame, and the end
    checks: np.ndarray
    doc_ids: list[int | None]
    starts: np.ndarray  # first id of each document, and the end


def read_index(file, size: int) -> FileIndex:
    n, descriptor, magic = struct.unpack(_FOOTER, read_range(file, size - _FOOTER_BYTES, _FOOTER_BYTES))
    if magic != _FOOTER_MAGIC or not descriptor & 0x80:
        raise ValueError("the file has no seek table with checksums")
    table = read_range(file, size - _FOOTER_BYTES - n * _ENTRY_BYTES - _HEAD_BYTES, _HEAD_BYTES + n * _ENTRY_BYTES)
    if struct.unpack_from(_HEAD, table)[0] != _SEEK_MAGIC:
        raise ValueError("the seek table is damaged")
    entries = np.frombuffer(table, dtype="<u4", offset=_HEAD_BYTES).reshape(n, 3).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(entries[:, 0])])
    packed = read_range(file, int(offsets[n - 1]), int(entries[n - 1, 0]))
    index = zstandard.ZstdDecompressor().decompress(packed[_HEAD_BYTES:])
    docs = len(index) // 17
    missing = np.frombuffer(index, dtype=np.uint8, count=docs)
    doc_ids = np.frombuffer(index, dtype="<i8", count=docs, offset=docs).tolist()
    counts = np.frombuffer(index, dtype="<i8", count=docs, offset=9 * docs)
    return FileIndex(offsets[:n - 1], entries[:n - 1, 0], np.concatenate([[0], np.cumsum(entries[:n - 1, 1] // 4)]), entries[:n - 1, 2],
                     [None if m else d for m, d in zip(missing, doc_ids, strict=True)], np.concatenate([[0], np.cumsum(counts)]))


class FileReader:
    """Documents of one file. The frame read last is kept, for documents are mostly asked for in order."""

    def __init__(self, file, size: int | None = None):
        self.file = file
        self.index = read_index(file, file.size() if size is None else size)
        self.zstd = zstandard.ZstdDecompressor()
        self.kept: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            ix = self.index
            content = self.zstd.decompress(read_range(self.file, int(ix.offsets[k]), int(ix.sizes[k])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != ix.checks[k]:
                raise ValueError(f"frame {k} does not have its checksum")
            self.kept = (k, content)
            self.frames_read += 1
        return self.kept[1]

    def blocks(self, at: int) -> Iterator[bytes]:
        """The ids of the document at a position of the index, frame by frame."""
        ix = self.index
        start, end = int(ix.starts[at]), int(ix.starts[at + 1])
        k = int(np.searchsorted(ix.firsts, start, side="right")) - 1
        while start < end:
            stop = min(end, int(ix.firsts[k + 1]))
            first = int(ix.firsts[k])
            yield self.frame(k)[4 * (start - first):4 * (stop - first)]
            start, k = stop, k + 1

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that id."""
        return [np.frombuffer(b"".join(self.blocks(k)), dtype="<u4") for k, d in enumerate(self.index.doc_ids) if d == doc_id]


_FILES = StructType([StructField("file", LongType(), False), StructField("path", StringType(), False), StructField("documents", LongType(), False),
                     StructField("ids", LongType(), False), StructField("bytes", LongType(), False)])


def write_files(documents: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 1, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write the ids of all texts below ``folder``; returns the written files (file, path, documents, ids, bytes), numbered in document order."""
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast({"definition": file.read()})  # a vocabulary file
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    tie = F.xxhash64("text")
    in_order = narrow.withColumn("_tie", tie).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    in_order = in_order.select(F.spark_partition_id().alias("_file"), "doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        kept = held.value
        if "encoder" not in kept:
            kept["encoder"] = WordEncoder(kept["definition"])
        encoder, number = kept["encoder"], first.column(0)[0].as_py()

        with written(folder, f"{number:06d}.tokens.zst") as (out, path):
            writer = FileWriter(out, frame_ids)
            for window in _windows(chain([first], batches)):
                for doc_id, blocks in zip(window.column(1).to_pylist(), encoder.texts(window.column(2)), strict=True):
                    writer.add(doc_id, chain(blocks, [end]))
            writer.finish()
        values = [number, path, len(writer.counts), sum(writer.counts), writer.bytes]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=_FILES.names)

    return materialize(in_order.mapInArrow(run, _FILES), "tokenfiles")


def file_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: the ids in all files before. One row a file, so one task can hold them."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, each file in a task of its own."""
    wanted = file_starts(files).select("path", "bytes", "start")
    wanted = wanted.repartition(max(1, files.count()), "path")
    schema = StructType([StructField("doc_id", LongType(), True), *[StructField(c, LongType(), False) for c in ("start", "n_tokens", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(path) as file:
                    reader = FileReader(file, size)
                    docs, starts = reader.index.doc_ids, reader.index.starts
                    for a in range(0, len(docs), 10_000):
                        part = range(a, min(a + 10_000, len(docs)))
                        sums = []
                        for k in part:
                            crc = 0
                            for block in reader.blocks(k):
                                crc = zlib.crc32(block, crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([docs[k] for k in part], pa.int64()), pa.array(starts[part.start:part.stop] + start),
                            pa.array(np.diff(starts[part.start:part.stop + 1])), pa.array(sums, pa.int64())], names=schema.names)

    return wanted.mapInArrow(run, schema)


def stored_ids(spark: SparkSession, documents: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the ids of ``documents`` to files of the shared folder and read them back."""
    return read_files(write_files(documents, tokenizer_path, scratch_path(spark, "tokens"), **options))
