"""Web archives in ZIP packages: written from pages, read by ranges without extraction.

A package is a ZIP file whose members are stored: an archive of WARC records, each compressed by itself, and an index that says where they are. The
reader takes the central directory from the end of the file (by way of the ZIP64 records where there are such), finds the archive and index members, turns the index into
ranges of whole records, and has tasks fetch and parse those ranges. Of records with equal payloads one is kept as a response; the
others are revisits that refer to it.

Defined cases: a null html is an empty payload; a null url leaves the header out; of equal payloads the row with the largest page_id is
the response (null ids are smallest; of repeated ids, one row); a package without an index is scanned; compressed archive members are refused; an empty table
gives no packages and no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shelfspark.llm.common import text_or_empty
from shelfspark.llm.files import opened, read_range, written
from shelfspark.session import materialize, scratch_path

#: Payload bytes and records after which a task starts its next package, and bytes that a reader fetches at once.
PACKAGE_BYTES, PACKAGE_RECORDS, RANGE_BYTES = 256 << 20, 200_000, 1 << 20
#: Stored bytes that one reading task should have at most, about.
TASK_BYTES = 64 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ZIP directories

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  # as stored
    header: int  # place of the local header


def read_directory(file, size: int) -> list[Member]:
    """The members that the central directory lists."""
    tail_start = max(0, size - 22 - 0xFFFF)
    tail = read_range(file, tail_start, size - tail_start)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        end = tail_start + at
        locator = read_range(file, end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    return list(_entries(read_range(file, start, length), count))


def _entries(directory: bytes, count: int) -> Iterator[Member]:
    at = 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<HH", directory, extra)
            if kind == 1:  # ZIP64: only the fields that did not fit above, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra += 4 + n
        yield Member(name, method, packed, header)
        at = end + n_comment


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin; the local header has name and extra fields of its own lengths."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = read_range(file, member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# -- Records

def record_bytes(row: dict, date: str) -> bytes:
    """A compressed WARC record; ``row`` has record_id, url, payload (None for a revisit), payload_bytes, digest and refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["payload"] is None else http + row["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['payload'] is None else 'response'}", f"WARC-Record-ID: <{row['record_id']}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{row['digest']}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~-._"))
    if row["payload"] is None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + packer.compress(block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Headers by lower-case name, the payload (None for a revisit), and the payload's full length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
        return headers, None, int(length[1]) if length else 0
    return headers, payload, len(payload)


def records_in(data: bytes) -> Iterator[bytes]:
    """The decompressed records of consecutive compressed ones."""
    while data:
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- Writing

_PACKAGES = StructType([StructField("path", StringType(), False), StructField("bytes", LongType(), False), StructField("records", LongType(), False)])


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with record_id, url, payload (null for revisits), payload_bytes and refers_to."""
    # Row numbers only settle ties of repeated ids; they hold for as long as the table is read the same way.
    plain = text_or_empty(F.col("html").cast("string")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), plain.alias("payload"))
    rows = rows.withColumns({"_row": F.monotonically_increasing_id(), "_sha1": F.sha1("payload")})
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    kept = large.groupBy("_sha1").agg(F.max(F.struct("page_id", "_row")).alias("_kept"))
    kept = kept.select(F.col("_sha1").alias("_key"), "_kept")
    joined = rows.join(kept, (F.col("_sha1") == F.col("_key")) & (F.octet_length("payload") >= least_bytes), "left")
    response = F.col("_kept").isNull() | (F.col("_kept._row") == F.col("_row"))

    def urn(page, row):
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))

    return joined.select(urn(F.col("page_id"), F.col("_row")).alias("record_id"), "url", F.when(response, F.col("payload")).alias("payload"),
                         F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.col("_sha1").alias("sha1"),
                         F.when(~response, urn(F.col("_kept.page_id"), F.col("_kept._row"))).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, *, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES,
                   package_records: int = PACKAGE_RECORDS, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages to packages below ``folder``; returns (path, bytes, records) of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(0, batch.num_rows, 256) for row in batch.slice(k, 256).to_pylist())
        row, number = next(rows, None), 0
        while row is not None:
            index, at, held = [], 0, 0
            with written(folder, f"{number:04d}.wacz") as (out, path):
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                    with package.open(ARCHIVE, "w", force_zip64=True) as archive:
                        while row is not None and held < package_bytes and len(index) < package_records:
                            row["digest"] = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                            record = record_bytes(row, date)
                            archive.write(record)
                            index.append(f"{row['record_id']} {json.dumps({'offset': at, 'length': len(record), 'filename': ARCHIVE.rpartition('/')[2]})}\n")
                            at, held = at + len(record), held + row["payload_bytes"]
                            row = next(rows, None)
                    package.writestr(INDEX, "".join(index))
                size = out.tell()
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([len(index)])], names=_PACKAGES.names)

    return materialize(with_responses(pages, least_bytes).mapInArrow(run, _PACKAGES), "packages")


# -- Reading

_RANGES = StructType([StructField("path", StringType(), False), StructField("start", LongType(), False), StructField("length", LongType(), False)])


def package_ranges(file, size: int, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of whole records, in the file."""
    members = read_directory(file, size)
    indexes = [m for m in members if m.name.endswith(".cdxj")]
    for archive in (m for m in members if m.name.endswith(".warc.gz")):
        first, name = data_start(file, archive), archive.name.rpartition("/")[2]
        spots = sorted({(e["offset"], e["length"]) for m in indexes for e in _index_lines(read_range(file, data_start(file, m), m.size))
                        if e.get("filename", name) == name})
        start = length = 0
        for offset, n in spots if indexes else _scanned(file, first, archive.size):
            if length and (offset != start + length or length + n > range_bytes):
                yield first + start, length
                length = 0
            if not length:
                start = offset
            length += n
        if length:
            yield first + start, length


def _index_lines(text: bytes) -> Iterator[dict]:
    for line in text.decode("utf-8").splitlines():
        if "{" in line:
            yield json.loads(line[line.index("{"):])


def _scanned(file, first: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the compressed records of an archive, found by reading it through."""
    at = record = 0
    unpacker, held = zlib.decompressobj(31), b""
    while at < size or held:
        if not held:
            held = read_range(file, first + at, min(step, size - at))
            at += len(held)
        unpacker.decompress(held)
        held = b""
        if unpacker.eof:
            held = unpacker.unused_data
            yield record, at - len(held) - record
            record, unpacker = at - len(held), zlib.decompressobj(31)


def read_records(packages: DataFrame, *, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the packages (path, bytes): record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, and the payload if wanted.

    A response whose payload does not have its digest is an error.
    """
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as file:
                    found = list(package_ranges(file, size, range_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([s for s, _ in found], pa.int64()),
                                                  pa.array([n for _, n in found], pa.int64())], names=_RANGES.names)

    names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", *["payload"] * with_payload]
    schema = StructType([StructField(c, LongType() if c == "payload_bytes" else BinaryType() if c == "payload" else StringType(), True) for c in names])
    kinds = [pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in names]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with opened(path) as file:
                    data = read_range(file, start, length)
                for record in records_in(data):
                    headers, payload, full = parse_record(record)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and base32_sha1(payload) != digest:
                        raise ValueError(f"{headers['warc-record-id']} does not have its digest")
                    refers = headers.get("warc-refers-to")
                    rows.append((headers["warc-record-id"].strip("<>"), headers["warc-type"], headers.get("warc-target-uri"), digest, full,
                                 refers and refers.strip("<>"), *[payload] * with_payload))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    spread = packages.select("path", "bytes").repartition(max(1, packages.count()), "path")
    # A row here stands for many bytes: tasks are counted by those, or Spark would take the few rows for one task's work.
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    return spread.mapInArrow(ranges, _RANGES).repartition(tasks, "path", "start").mapInArrow(fetch, schema)


def archived(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to packages of the shared folder and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    records = read_records(write_packages(pages, scratch_path(spark, "archives"), least_bytes=least_bytes), with_payload=False)

    def page(urn: str):
        return F.split_part(urn, F.lit(":"), F.lit(3)).try_cast("bigint")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
