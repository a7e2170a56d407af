"""Archives, neighbours, token files, chat repair and the pipeline against brute force and on defined cases."""

import base64
import collections
import hashlib
import io
import itertools
import json
import random
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import blockjoin, chat, suite, tokenfiles, warczip
from shelfspark.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


# -- archives

def _archived(rows, least=0):
    best, out = {}, []
    for k, (page, _, html) in enumerate(rows):
        if len(payload := (html or "").encode()) >= least:
            key, rank = hashlib.sha1(payload).digest(), (page is not None, page or 0)
            if key not in best or rank > best[key][0]:
                best[key] = (rank, k, page)
    for k, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        kept = best.get(hashlib.sha1(payload).digest()) if len(payload) >= least else None
        response = kept is None or kept[1] == k
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit",
                    None if response else kept[2]))
    return sorted(map(str, out))


PAGES = [(1, "http://a/\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "q"), (7, "ü", "q\r\n\r\nz"), (8, "u", "same")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as _row", "3 as record_id")


@pytest.mark.parametrize("least", [0, 1, 5])
def test_pages_come_back_from_archives(spark, pages, least):
    assert sorted(str(tuple(r)) for r in warczip.archived(spark, pages, least).collect()) == _archived(PAGES, least)


def test_repeated_page_ids_have_one_response(spark):
    rows = spark.createDataFrame([(5, "u", "x")] * 4, "page_id long, url string, html string")
    assert sorted(r.record_type for r in warczip.archived(spark, rows).collect()) == ["response"] + ["revisit"] * 3


def test_packages_roll_and_payloads_are_whole(spark, pages):
    packages = warczip.write_packages(pages, scratch_path(spark, "archives"), package_records=2)
    records = warczip.read_records(packages, range_bytes=300).collect()
    assert packages.count() >= 3 and len(records) == len(PAGES)
    assert b"q\r\n\r\nz" in {bytes(r.payload) for r in records if r.payload is not None}
    assert warczip.archived(spark, pages.limit(0)).count() == 0


def _zip64(body, name=b"archive/data.warc.gz"):
    """A package whose sizes and places stand in ZIP64 fields only, without an index."""
    out = io.BytesIO()
    out.write(b"some bytes in front")
    local = out.tell()
    out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
              + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body)
    start = out.tell()
    out.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF)
              + name + struct.pack("<HHQQQ", 1, 24, len(body), len(body), local))
    end = out.tell()
    out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, end - start, start))
    out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end")
    return out.getvalue()


def test_zip64_directories_and_scanned_archives():
    row = {"record_id": "urn:page:5:0", "url": "u", "payload": b"hi", "payload_bytes": 2, "digest": warczip.base32_sha1(b"hi"), "refers_to": None}
    record = warczip.record_bytes(row, "1970-01-01T00:00:00Z")
    data = _zip64(record * 3)
    file = pa.BufferReader(data)
    member, = warczip.read_directory(file, len(data))
    assert (member.name, member.method, member.size, member.header) == ("archive/data.warc.gz", 0, 3 * len(record), 19)
    first = warczip.data_start(file, member)
    assert list(warczip.package_ranges(file, len(data), 10)) == [(first + k * len(record), len(record)) for k in range(3)]
    assert [warczip.parse_record(r)[1] for r in warczip.records_in(record * 3)] == [b"hi"] * 3
    with pytest.raises(ValueError):
        warczip.read_directory(pa.BufferReader(data[:-30]), len(data) - 30)


# -- neighbours

def test_tiles_equal_brute_force():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6000, 24))
    vectors[100:1500] = vectors[0]
    vectors[3000:3300] *= 1e-30
    vectors[4000] *= 1e30
    ids = rng.permutation(6000)
    chosen = [*range(30), *range(3000, 3010), 4000]
    found = blockjoin.tile_nearest(ids[chosen], vectors[chosen], ids, vectors, 10)
    for own, best in zip(chosen, found, strict=True):
        distance = np.sqrt(np.add.accumulate((vectors - vectors[own]) ** 2, axis=1)[:, -1])
        assert best == [(distance[j], ids[j]) for j in np.lexsort((ids, distance)) if j != own][:10]


@pytest.mark.parametrize(("shard_bytes", "part_queries"), [(4 << 20, 1024), (16, 1)])
def test_neighbours_of_odd_rows(spark, shard_bytes, part_queries):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0, 1.0]), (6, [None, 1.0]),
            (7, [2.0, 2.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as _id", "3 as query_id")
    found = blockjoin.nearest(vectors, vectors.filter("vec_id IN (0, 2, 5)"), k=3, shard_bytes=shard_bytes, part_queries=part_queries)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(0, 1, 1), (0, 2, 8), (0, 3, 7)]
    assert blockjoin.nearest(vectors.limit(0), vectors).count() == 0


# -- token files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_words_encode_as_whole_texts_do(library):
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = tokenfiles.WordEncoder(file.read())
    rng = random.Random(4)
    parts = [*"abcABCéÉßΣσ'sdl 1234  \n\t.,İ́ x|<>\x1f\x0b\x85\u00a0\u00d7ŸſŒK½", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " don't. ", "'re", "...", "a.", "é.", "9,", "=\u0338"]
    texts = []
    for k in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        if k % 5 == 0:
            text = "".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(1, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(12))
        texts.append(text)
    for start in range(0, len(texts), 400):
        for text, blocks in zip(texts[start:start + 400], encoder.texts(pa.array(texts[:start + 400])[start:]), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(b"".join(blocks), "<u4").tolist() == expected, text
            assert np.frombuffer(b"".join(encoder.text(text, piece=2)), "<u4").tolist() == expected, text


def test_words_of_other_tokenizers_go_through_the_library(library):
    other = json.loads(library.to_str())
    other["normalizer"] = {"type": "Lowercase"}
    encoder, whole = tokenfiles.WordEncoder(json.dumps(other)), Tokenizer.from_str(json.dumps(other))
    for text in ("Hello, w|rld don't", "a.b <|endoftext|>é", ""):
        assert np.frombuffer(b"".join(encoder.text(text)), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_forgotten_words_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMO_WORDS", 8)
    encoder = tokenfiles.WordEncoder(library.to_str())
    text = " ".join(f"word{'abcdefghij'[k % 10]}{k % 23}, x." for k in range(200))
    assert np.frombuffer(b"".join(encoder.text(text, piece=70)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def _expected(rows, library):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_come_back(spark, library):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = sorted(tuple(r) for r in tokenfiles.stored_ids(spark, documents, TOKENIZER, frame_ids=300).collect())
    assert found == _expected([(r.doc_id, r.text) for r in documents.collect()], library)
    odd = [(3, None), (None, "a b"), (1, ""), (3, ""), (5, "One <|endoftext|> two"), (6, "long " * 300_000), (7, "a <|ENDOFTEXT|>")]
    rows = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 as start", "'f' as _file")
    assert sorted(map(str, (tuple(r) for r in tokenfiles.stored_ids(spark, rows, TOKENIZER).collect()))) == sorted(map(str, _expected(odd, library)))
    assert tokenfiles.stored_ids(spark, rows.limit(0), TOKENIZER).count() == 0


def test_readers_fetch_only_the_frames_they_need():
    out = io.BytesIO()
    writer = tokenfiles.FileWriter(out, frame_ids=10)
    contents = {k: np.arange(k, k + 3 + 7 * (k % 3), dtype="<u4") for k in range(40)}
    for k, ids in contents.items():
        writer.add(k, [ids.tobytes()])
    writer.finish()
    reader = tokenfiles.FileReader(pa.BufferReader(out.getvalue()))
    assert [d.tolist() for d in reader.document(11)] == [contents[11].tolist()]
    assert reader.frames_read <= 3
    damaged = bytearray(out.getvalue())
    damaged[int(reader.index.offsets[0]) + 12] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - the decompressor or the checksum finds it
        tokenfiles.FileReader(pa.BufferReader(bytes(damaged))).document(0)


# -- chat

def _legal(roles):
    state = chat.START
    for role in roles:
        if role not in chat._NEXT[state]:
            return False
        state = chat.AFTER[role]
    return state in (2, 3)


def _least_cost(roles):
    best = 10 ** 9

    def go(k, made, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(roles):
            if _legal(made):
                best = cost
            elif made and _legal([*made, "user"]):
                best = min(best, cost + chat.INSERT)
            return
        for role in chat.ROLES:
            label = 0 if role == roles[k] else chat.RELABEL if roles[k] in chat.ROLES else chat.NAME
            go(k + 1, [*made, role], cost + label)
            if made and made[-1] == role:
                go(k + 1, made, cost + chat.MERGE + label)
            for empty in chat.ROLES:
                go(k + 1, [*made, empty, role], cost + chat.INSERT + label)

    go(0, [], 0)
    return best


def test_repairs_cost_the_least():
    for n in range(1, 4):
        for roles in itertools.product([*chat.ROLES, None], repeat=n):
            assert chat.repair(list(roles))[0] == _least_cost(roles), roles


@pytest.mark.parametrize("segment_turns", [4096, 3])
def test_rendered_conversations(spark, segment_turns):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "System ", "tool", None, "user", "assistant"]), rng.choice(["hi", "", None, "a<|im_end|>b"]))
            for c in range(20) for t in range(rng.randint(1, 30))] + [(None, 1, "system", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as seq", "2 as _rank", "3 as cost")
    found = {r.conv_id: r for r in chat.rendered(chat.format_conversations(table, segment_turns)).collect()}
    roles = collections.defaultdict(list)
    for conv, turn, role, _ in rows:
        roles[conv].append((turn, chat._known(role and role.strip().lower())))
    assert set(found) == set(roles)
    for conv, row in found.items():
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", row.text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns) == row.text
        assert _legal([role for role, _ in turns]) and len(turns) == row.n_turns
        assert row.cost == chat.repair([role for _, role in sorted(roles[conv], key=lambda r: r[0])])[0]
    assert chat.format_conversations(table.limit(0), segment_turns).count() == 0


def test_conversations_with_ids_of_any_type(spark):
    rows = [("c1", "b", "assistant", "x"), ("c1", "a", "user", "y"), (None, "a", "tool", "z"), ("ü:2", None, "user", None)]
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string"))
    assert [(r.conv_id, r.text) for r in chat.rendered(found).orderBy("conv_id").collect() if r.conv_id == "c1"] == [
        ("c1", "<|im_start|>user\ny<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n")]
    assert {(r.conv_id, r.turn) for r in found.filter("turn IS NOT NULL").collect()} == {("c1", "a"), ("c1", "b"), (None, "a")}


# -- queries and pipeline

@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLE)))
def test_queries_run(spark, name):
    assert suite.QUERIES[name](spark, SF_DIR).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert 0 < docs.count() < 200 and corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()
