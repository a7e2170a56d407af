"""The corpus pipeline's rows against each stage by brute force."""

import hashlib
import os
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from shelfspark.llm import toxicity
from tests.llm.test_text_operators import _overlaps, _plain, _simhash, network_score

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _clean_of_toxicity(spark, rows):
    model = toxicity.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    return [r for r in rows if network_score(model, r["text"]) < model.thresholds.get(r["lang"], model.default_threshold)]


def _one_of_each_group(rows):
    """All pairs of fingerprints, groups by repeated relabelling; the smallest id of a group stays."""
    prints = [_simhash(r["text"]) for r in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label):
        least[x] = min(least.get(x, r["doc_id"]), r["doc_id"])
    return [r for r, x in zip(rows, label) if r["doc_id"] == least[x]]


def _not_in_the_benchmark(rows, items):
    words = [(k, re.sub(r"[^\w]+", " ", (text or "").lower()).split()) for k, text in items]
    leaking = {doc for doc, _ in _overlaps([(r["doc_id"], r["text"]) for r in rows], words)}
    return [r for r in rows if r["doc_id"] not in leaking]


def _redacted(text):
    """Plain identifiers replaced by their kinds, overlapping ones together by that of the first."""
    found = sorted((a, -b, kind) for kind, spans in _plain(text or "").items() for a, b in spans)
    out, at = "", 0
    for start, end, kind in found:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, -end)
    return out + text[at:] if found else text


def test_rows_of_every_stage_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    expected, lost = rows, []
    for name, brute in (("toxicity", lambda kept: _clean_of_toxicity(spark, kept)), ("near_duplicates", _one_of_each_group),
                        ("decontamination", lambda kept: _not_in_the_benchmark(kept, items))):
        before, expected = len(expected), brute(expected)
        lost.append(before - len(expected))
        docs = spark.createDataFrame([tuple(r.values()) for r in [x.asDict() for x in stages[name](spark, docs, SF_DIR).collect()]], docs.schema)
        assert sorted(map(str, (r.asDict() for r in docs.collect()))) == sorted(map(str, expected)), name
    assert all(lost), lost  # each stage had something to do
    redacted = {r.doc_id: r.asDict() for r in stages["pii"](spark, docs, SF_DIR).collect()}
    wanted = {r["doc_id"]: _redacted(r["text"]) for r in expected}
    assert {k: r["text"] for k, r in redacted.items()} == wanted
    assert any(wanted[r["doc_id"]] != r["text"] for r in expected)
    assert all({**r, "text": wanted[r["doc_id"]], "n_chars": redacted[r["doc_id"]]["n_chars"]} == redacted[r["doc_id"]] for r in expected)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        import base64
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.read().splitlines() if line)}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = set()
    for doc, text in wanted.items():
        ids = library.encode_ordinary(text or "")
        final.add((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    found = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(found) == len(final) and {tuple(r) for r in found} == final
