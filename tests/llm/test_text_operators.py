"""Toxicity, SimHash, decontamination, licences, personal data and BPE against brute force and on defined cases."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfspark.llm import bytepair, decontaminate, licences, pii, simhash, toxicity

DOCS = "doc_id long, text string"


# -- toxicity

BAD, GOOD = ["scumbag", "morons", "idiotic", "vermin"], [f"w{a}{b}" for a in "bcdfg" for b in "aeiou"]


def _labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 60))]
        toxic = k % 3 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        rows.append((k, " ".join(words), "en" if k % 2 else "de", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxicity_tables(spark):
    rows = _labelled(1200, 1)
    return (spark.createDataFrame([r[:3] for r in rows], DOCS + ", lang string").selectExpr("*", "1 as score"),
            spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), rows)


def test_toxicity_on_the_held_out_fold(spark, toxicity_tables):
    documents, labels, rows = toxicity_tables
    model = toxicity.fit(documents, labels)
    assert set(model.thresholds) == {"de", "en"}
    found = {r.doc_id: r._toxicity for r in toxicity.score(documents, model, "_toxicity").collect()}
    unseen = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 3 == 1]
    assert sum((found[r[0]] >= 0.7) == bool(r[3]) for r in unseen) >= 0.97 * len(unseen)
    kept = {r.doc_id for r in toxicity.keep_clean(documents, model).collect()}
    assert sum((r[0] in kept) == (r[3] == 0) for r in rows) >= 0.97 * len(rows)
    # Nothing but the text counts, and odd rows get a score.
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "  ", None), (3, "  ", None)], DOCS + ", lang string")
    assert len({r.s for r in toxicity.score(odd, model, "s").collect()}) == 1
    assert toxicity.score(odd.limit(0), model, "s").count() == 0


def test_toxicity_labels_of_the_held_out_fold_are_not_read(spark, toxicity_tables):
    documents, labels, _ = toxicity_tables
    from pyspark.sql import functions as F
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(documents, labels), toxicity.fit(documents, other)
    assert np.array_equal(a.embedding, b.embedding) and a.thresholds == b.thresholds


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """A word that only a few long documents hold counts, and slices side by side come to what one of them comes to."""
    rows = _labelled(1200, 8)
    padding = " ".join(["harmless"] * 15_000)
    rows += [(k, f"{padding} zyxword {padding}" if k % 2 else padding, "en", k % 2) for k in range(5000, 5060)]
    documents = spark.createDataFrame([r[:3] for r in rows], DOCS + ", lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    unseen = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 3 == 1]
    for size in (4000, 200):
        monkeypatch.setattr(toxicity, "SLICE_DOCUMENTS", size)
        model = toxicity.fit(documents, labels)
        hasher = toxicity.WordHasher(model.buckets)
        assert model.embedding[hasher._piece(b"zyxword")[0, 0], 0] > 0.3
        right = sum((toxicity.score_text(model, hasher, r[1]) >= 0.7) == bool(r[3]) for r in unseen)
        assert right >= 0.97 * len(unseen)


def test_thresholds_from_steps():
    low, high = np.array([0.1, 0.4, 0.9]), np.array([0.2, 0.6, 0.95])
    assert toxicity.best_threshold(low, high, np.array([0, 1, 9]), np.array([9, 3, 0]), 0.7) == pytest.approx(0.75)
    assert toxicity.best_threshold(low, high, np.array([0, 3, 9]), np.array([9, 1, 0]), 0.7) == pytest.approx(0.5)


def test_toxicity_without_a_class(spark):
    documents = spark.createDataFrame([(1, "a", "en")], DOCS + ", lang string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(documents, toxicity.fit(documents, empty), "s").first().s == pytest.approx(0.5)


def test_toxicity_pieces_do_not_change_the_score():
    rows = _labelled(300, 2)
    model = toxicity.train([r[1] for r in rows], np.array([r[3] for r in rows]))
    text = " ".join(r[1] for r in rows)
    whole = toxicity.WordHasher(model.buckets)
    ids = np.concatenate(list(whole.pieces(text)))
    for size in (1, 2, 7):
        parts = [ids[k:k + size] for k in range(0, len(ids), size)]
        assert np.allclose(toxicity._pool(model, iter(parts)), toxicity._pool(model, iter([ids])))


def network_score(model, text):
    """The network by plain loops: hashes of words and of their beginnings, every filter at every word, the largest answers, a logistic layer."""
    def row(piece, salt):
        h = sum((b + 1) * pow(int(toxicity._BASE), k, 1 << 64) for k, b in enumerate(piece)) % (1 << 64) ^ int(salt)
        h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
        return (h ^ h >> 32) % model.buckets

    vectors = []
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode()):
        pieces = [word, *[word[:n] for n in toxicity.PREFIXES if len(word) >= n]]
        vectors.append(sum(model.embedding[row(p, s)].astype(float) for p, s in zip(pieces, toxicity._SALTS)))
    logit, at = model.bias, 0
    for filters in model.filters:
        for k in range(filters.shape[2]):
            answers = [sum(float(filters[j, :, k] @ vectors[i + j]) for j in range(len(filters)) if i + j < len(vectors)) for i in range(len(vectors))]
            logit += math.tanh(max(answers)) * model.weights[at] if answers else 0
            at += 1
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


def test_toxicity_scores_equal_plain_loops():
    rows = _labelled(300, 4)
    model = toxicity.train([r[1] for r in rows], np.array([r[3] for r in rows]))
    hasher = toxicity.WordHasher(model.buckets)
    odd = [None, "", " ,", "a", "Idiotic", "vermin w1", "ÄRGER über idiotische morons", "abc abcd abcde abcdef abcdefg", "x" * 300]
    for text in [*odd, *[r[1].upper() if r[0] % 2 else r[1] for r in _labelled(60, 5)]]:
        assert toxicity.score_text(model, hasher, text) == pytest.approx(network_score(model, text), abs=1e-5)


def test_training_improves_on_the_start():
    """The network starts from log-odds; on rows it has not seen, training makes its scores better than those."""
    rows, unseen = _labelled(400, 6), _labelled(200, 7)
    losses = []
    for epochs in (0, 2):
        model = toxicity.train([r[1] for r in rows], np.array([r[3] for r in rows]), epochs=epochs)
        hasher = toxicity.WordHasher(model.buckets)
        scores = [toxicity.score_text(model, hasher, r[1]) for r in unseen]
        losses.append(-sum(math.log(s if r[3] else 1 - s) for r, s in zip(unseen, scores)) / len(unseen))
    assert losses[1] < 0.5 * losses[0]


# -- SimHash

def _simhash(text, n=3):
    import xxhash
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    shingles = [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB é\t\n\x0b\x1cß") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", " ", "one", "one two", "x y z " * 60_000]
    assert [simhash.fingerprint(t) for t in texts] == [_simhash(t) for t in texts]


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, tree_nodes):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)})
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    groups = {}
    for f in prints:
        groups.setdefault(root(f), set()).add(f)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "node long")
    found = {}
    for node, top in simhash.components(simhash.links(nodes, 2, tree_nodes)).collect():
        found.setdefault(top, {top & (2 ** 64 - 1)}).add(node & (2 ** 64 - 1))
    assert {frozenset(v) for v in found.values()} == {frozenset(v) for v in groups.values() if len(v) > 1}


def test_near_duplicates_on_odd_rows(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "zz qq"), (None, "zz qq"), (7, "A B C D")]
    documents = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _fp", "'q' as root", "2 as component_id")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(documents).collect()), key=str)
    assert found == sorted([(1, 1), (2, 1), (7, 1), (3, 3), (4, 3), (5, 5), (5, 5), (None, None), (None, None)], key=str)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "3", "5", "None"]
    assert simhash.keep_one(documents.limit(0)).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_kept_rows_under_any_column_name(spark, repeated):
    """Every name that the operator uses for itself, as a column of the documents."""
    names = ["_own", "_fp", "_root", "_component", "_once", "_again", "_key", "_row", "row", "root", "component", "component_id", "fingerprint", "node", "n", "first_id", "__own", "A", "b"]
    rows = [(1, "one two three four"), (2, "one two three four"), (3, "some other words here")] + [(3, "quite another text of words"), (None, "no id at all")] * repeated
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{k} AS `{name}`" for k, name in enumerate(names)])
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "3", "3", "None"] if repeated else ["1", "3"])


# -- decontamination

def _overlaps(docs, items, similarity=0.8):
    out = set()
    for doc, text in docs:
        words = re.sub(r"[^\w]+", " ", (text or "").lower()).split()
        for item, own in items:
            if len(own) < 5 or len(words) < 5:
                continue
            places = {}
            for j, w in enumerate(own):
                places.setdefault(w, []).append(j)
            shifts = Counter(i - j for i, w in enumerate(words) for j in places.get(w, ()))
            for shift in (s for s, n in shifts.items() if n >= 5):  # fewer equal words are never enough
                equal = [words[shift + j] == w for j, w in enumerate(own) if 0 <= shift + j < len(words)]
                score = run = best = stretch = 0
                for e in equal:
                    score = max(0, score + (1 if e else -4))
                    run = run + e if score else 0
                    if score > best:
                        best, stretch = score, run
                enough = sum(equal) >= math.ceil(similarity * len(own) - 1e-9) and (len(own) > 5 or all(equal))
                if enough or stretch >= 13 or stretch >= 8 and 2 * stretch >= len(own):
                    out.add((doc, item))
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 8, 14, 30]))]) for k in range(30)]
    docs = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        if k % 2:
            own = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(own) // 3))):
                own[rng.randrange(len(own))] = "zz"
            at = rng.randint(0, len(words))
            words[at:at] = own[rng.choice([0, 0, 3]):]
        docs.append((k, " ".join(w.upper() + rng.choice(["", ",", "."]) if rng.random() < 0.3 else w for w in words)))
    docs += [(900, None), (901, ""), (None, " ".join(items[1][1]))]
    documents = spark.createDataFrame(docs, DOCS).selectExpr("*", "5 as _i", "1 as item_id")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(77, None)], "item_id long, text string").selectExpr("*", "7 as doc_id")
    wanted = _overlaps(docs, items)
    for at_once in (10 ** 6, 150):
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(documents, benchmark, broadcast_seeds=at_once).collect()} == wanted
    assert decontaminate.keep_clean(documents, benchmark).count() == len(docs) - len({d for d, _ in wanted})
    assert decontaminate.overlaps(documents.limit(0), benchmark).count() == 0
    assert decontaminate.overlaps(documents, benchmark.limit(0)).count() == 0


def _found(spark, docs, items, **options):
    documents = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], DOCS)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    return {(r.doc_id, r.item_id, r.stretch_words) for r in decontaminate.overlaps(documents, benchmark, **options).collect()}


def test_partial_passages_of_long_items(spark):
    items = [(1, [f"a{k}" for k in range(59)]), (2, [f"b{k}" for k in range(200)])]
    a, b, other = items[0][1], items[1][1], [f"c{k}" for k in range(30)]
    docs = [(1, other + a[20:49] + other), (2, b[100:190]), (3, other + a[:12]), (4, a[:14] + ["zz"] + a[14:28])]
    assert _found(spark, docs, items) == {(1, 1, 29), (2, 2, 90), (4, 1, 14)}


def test_seeds_do_not_grow_with_their_items(spark):
    long = [f"l{k}" for k in range(2000)]
    items = [(1, long), (2, long), (None, long), (2, [f"m{k}" for k in range(9)])]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    seeds = decontaminate.benchmark_seeds(decontaminate.benchmark_items(benchmark))
    assert {type(f.dataType).__name__ for f in seeds.schema} <= {"LongType", "IntegerType"}
    assert seeds.count() <= len(decontaminate.MASKS) * (2000 + 9)  # Equal items share their seeds.
    docs = [(1, ["x"] + long), (2, long[:1000] + ["x"]), (3, items[3][1])]
    assert _found(spark, docs, items, broadcast_seeds=4000) == {(d, i, n) for d, n in ((1, 2000), (2, 1000)) for i in (1, 2, None)} | {(3, 2, 9)}


def test_every_agreement_of_four_fifths_holds_a_seed():
    span = max(map(max, decontaminate.MASKS)) + 1
    most = {(): 0}  # By the last equalities, the most equal words of a passage without a seed.
    for length in range(1, 121):
        longer = {}
        for last, equal in most.items():
            for e in (0, 1):
                seen = (*last, e)
                # A mask that ends here; masks that end earlier were looked at there.
                if not any(len(seen) > m[-1] and all(seen[len(seen) - 1 - m[-1] + k] for k in m) for m in decontaminate.MASKS):
                    longer[seen[-span + 1:]] = max(longer.get(seen[-span + 1:], 0), equal + e)
        most = longer
        assert length < 6 or max(most.values()) < math.ceil(0.8 * length - 1e-9), length


def test_two_words_replaced_in_the_middle(spark):
    item = [f"a{k}" for k in range(10)]
    assert {r[:2] for r in _found(spark, [(1, item[:4] + ["x", "y"] + item[6:])], [(1, item)])} == {(1, 1)}


# -- licences

def test_licences(spark):
    known = licences.known_digests(spark)
    mit = licences.KNOWN_TEXTS["MIT"][0]
    for texts in licences.KNOWN_TEXTS.values():
        assert all(re.search(licences.CUE, t) for t in texts)
    rows = [(1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,")), (3, mit + " more"), (4, "a\nLicenced under the MIT Licence!\r\nb"),
            (5, None), (6, ""), (None, "SPDX-License-Identifier: ISC"), (6, "")]
    documents = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _row", "2 as licence", "3 as digest")
    found = sorted(((str(r.doc_id), r.licence, r.notices, r.n_notices) for r in licences.scan(documents, known).collect()), key=str)
    assert found == sorted([("1", "MIT", "", 0), ("2", "MIT", "", 0), ("3", None, "", 0), ("4", None, "MIT", 1), ("5", None, "", 0), ("6", None, "", 0),
                            ("6", None, "", 0), ("None", "ISC", "ISC", 1)], key=str)
    assert licences.scan(documents.limit(0), known).count() == 0


def test_full_licence_texts(spark):
    names = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"]
    rows, wanted = [], {}
    for name in names:
        with open(f"{os.path.dirname(licences.__file__)}/licence_files/{name}.txt", encoding="utf-8") as file:
            text = file.read()
        joined = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))
        for form, licence in ((text, name), (text.upper().replace("\n", "\r\n"), name), (joined, name), (" ".join(text.split()), name),
                              (text.split("END OF TERMS")[0], name), (text + " more", None)):
            wanted[len(rows)] = licence
            rows.append((len(rows), form))
    found = licences.scan(spark.createDataFrame(rows, DOCS), licences.known_digests(spark)).collect()
    assert {r.doc_id: r.licence for r in found} == wanted


# -- personal data

def _plain(text):
    def numbers(m):
        return re.sub("[^0-9]", "", m.group())

    def good_card(m):
        d = numbers(m)[::-1]
        return 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d)) % 10 == 0

    rules = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", good_card),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(numbers(m)) <= 15)}
    return {k: [m.span() for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in rules.items()}


def test_plain_scanners_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(8000):
        text = "".join(rng.choice("ab1.2@-+ (3%04") for _ in range(rng.randint(0, 45)))
        assert {k: list(scan(text)) for k, scan in pii.SCANNERS.items()} == _plain(text), text
    for text in ("4111 1111-1111 1111", "x4111111111111111y", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567 +", "a@b.c@d.e"):
        assert {k: list(scan(text)) for k, scan in pii.SCANNERS.items()} == _plain(text), text


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("write jоhn.dоe@exаmple.com now", "email", "jоhn.dоe@exаmple.com"),
    ("john (at) example (dot) com", "email", "john (at) example (dot) com"),
    ("jane at example dot org!", "email", "jane at example dot org"),
    ("bob@​example.com", "email", "bob@​example.com"),
    ("call plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
    ("ip 10 dot 0 dot 0 dot 1 ok", "ip", "10 dot 0 dot 0 dot 1"),
    ("４１１１ 1111 1111 １111.", "card", "４１１１ 1111 1111 １111"),
])
def test_disguised_identifiers_are_mapped_back(text, kind, span):
    assert [(k, text[a:b]) for k, a, b, disguised in pii.find(text) if disguised] == [(kind, span)]
    assert pii.redact_text(text) == text.replace(span, f"[{kind.upper()}]")


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("call +49 one 234 five 678 90 now", "phone", "+49 one 234 five 678 90"),
    ("call +1 555 12 seven 0 now", "phone", "+1 555 12 seven 0"),
    ("card 4111 one 111 1111 11 one 1 ok", "card", "4111 one 111 1111 11 one 1"),
    ("card 4111 1111 1111 111 one.", "card", "4111 1111 1111 111 one"),
    ("ip 10.0.0 dot seven ok", "ip", "10.0.0 dot seven"),
    ("to john       (at)      example       [dot]    com.", "email", "john       (at)      example       [dot]    com"),
])
def test_spelled_digits_beside_numbers(text, kind, span):
    assert [(k, text[a:b]) for k, a, b, disguised in pii.find(text) if disguised] == [(kind, span)]
    assert pii.redact_text(text) == text.replace(span, f"[{kind.upper()}]")
    other = "two seven one. " + text  # What else a text holds does not matter.
    assert [(k, other[a:b]) for k, a, b, _ in pii.find(other)] == [(kind, span)]


def test_single_spelled_digits_take_no_identifier_away():
    assert not pii.find("page 12 un 345, rule one 2 3 or 5, 10 two")
    text = "call +1 555 123 456 seven now"  # The plain span stays, and the last digit is redacted with it.
    assert [s[1:] for s in pii.find(text)] == [(5, 19, False), (5, 25, True)] and pii.redact_text(text) == "call [PHONE] now"
    for text in ("４１１１ 1111 1111 １111 un 2 3", "4111 1111 1111 1111 un 2 3"):
        assert [(k, a, b) for k, a, b, _ in pii.find(text)] == [("card", 0, 19)]


def _disguises(rng):
    """(kind, text) of a random identifier under a random disguise."""
    digits = "zero one two three four five six seven eight nine".split()
    look = str.maketrans({"a": "а", "e": "е", "o": "о", "c": "с"})
    word = lambda: "".join(rng.choice("bcdfghklmnprsaeo") for _ in range(rng.randint(3, 9)))
    kind = rng.choice(["email", "ip", "card", "phone"])
    if kind == "email":
        if rng.random() < 0.3:
            return kind, f"{word()}a.{word()}@{word()}e.com".translate(look)
        dot = rng.choice([" (dot) ", "[dot]", " dot ", " {punkt} ", "  [.]  "])
        return kind, word() + rng.choice([" (at) ", "[at]", " at ", " <ät> ", " @ ", "(@)"]) + dot.join([word(), *[word()] * rng.randint(0, 2), "org"])
    if kind == "ip":
        return kind, rng.choice([" dot ", " (dot) ", "[.]", " punkt "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = [rng.randint(0, 9) for _ in range(15)]
        body.append(-sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(body)) % 10)
        return kind, "".join((chr(0xFF10 + d) if k % 4 == 1 else str(d)) + (" " if k % 4 == 3 and k < 15 else "") for k, d in enumerate(body))
    body = [rng.randint(0, 9) for _ in range(rng.randint(8, 15))]
    spelled = {0, *rng.sample(range(1, len(body)), 5)}
    return kind, rng.choice(["+", "plus "]) + " ".join(digits[d] if k in spelled else str(d) for k, d in enumerate(body))


def test_generated_disguises_are_found_where_they_are():
    """Random identifiers under random disguises, each as one span that maps back to its very characters, whatever stands around it."""
    rng = random.Random(12)
    around = ["", "call ", "Größe; ", "straße 😀 — ", "write to: ", "\n", "é "]
    kinds = Counter()
    for _ in range(3000):
        kind, disguised = _disguises(rng)
        before, after = rng.choice(around), rng.choice(["", " now", ", thanks", "\nthen", " 😀", "!"])
        text = before + disguised + after
        if any(_plain(text).values()):
            continue  # a part of it is plain as it stands
        kinds[kind] += 1
        assert [(k, text[a:b], d) for k, a, b, d in pii.find(text)] == [(kind, disguised, True)], text
        assert pii.redact_text(text) == f"{before}[{kind.upper()}]{after}"
    assert min(kinds.values()) > 400 and len(kinds) == 4, kinds


def test_harmless_texts_have_no_spans():
    for text in ("look at example.com", "one two buckle my shoe", "meet at noon dot", "", None, "résumé 1.2.3"):
        assert pii.find(text) == []


def test_pii_tables(spark):
    rows = [(1, "mail a@b.co or c (at) d (dot) org"), (2, None), (2, None), (None, "+49 30 1234567")]
    documents = spark.createDataFrame(rows, DOCS).selectExpr("*", "99L as n_chars", "1 as spans", "2 as n_email")
    found = {r.doc_id: r for r in pii.report(documents).collect()}
    assert (found[1].n_email, found[1].spans) == (2, "email:5:11,email:15:33")
    assert found[1].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert found[2].spans == "" and found[None].n_phone == 1
    redacted = sorted(((r.text, r.n_chars) for r in pii.redact(documents).collect()), key=str)
    assert redacted == sorted([("mail [EMAIL] or [EMAIL]", 23), (None, 99), (None, 99), ("[PHONE]", 7)], key=str)
    assert [len(r["found"]) for r in pii.detect(documents, "found").orderBy("doc_id").collect()] == [1, 2, 0, 0]
    assert pii.report(documents.limit(0)).count() == 0


# -- BPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "abcehilnorst  \n'.,1234éñß字\U0001f600\x1c\x85  -_=ABC\t"


@pytest.fixture(scope="module")
def encoders():
    with open(RANKS, "rb") as file:
        encoder = bytepair.Encoder(bytepair.Vocabulary(file.read()), public_tokenizers.PATTERN)
    return encoder, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def test_bpe_equals_the_library(encoders):
    encoder, library = encoders
    rng = random.Random(2)
    for k in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))
        if k % 5 == 0:
            text = "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1F000)])) for _ in range(12))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert encoder.vocabulary.decode(ids) == text.encode()
    for text in ("a" * 3000, " " * 3000, "abcd efg\n" * 80_000, ""):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_prefix_tables_and_edits(encoders):
    encoder, library = encoders
    table = bytepair.PrefixTable(encoder.vocabulary, b"international")
    table.append(b"isation")
    assert [table.ids(k) for k in range(21)] == [library.encode_ordinary("internationalisation"[:k]) for k in range(21)]
    table.replace(5, 8, b"xy")
    assert table.ids() == library.encode_ordinary("inter" + "xy" + "internationalisation"[8:])
    rng = random.Random(7)
    for _ in range(600):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))
        edited = bytepair.EditableText(encoder, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = rng.choice([a, rng.randint(a, min(len(text), a + 5))])
            new = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 5)))
            text = text[:a] + new + text[b:]
            edited.replace(a, b, new)
            assert edited.ids() == library.encode_ordinary(text)
    long = bytepair.EditableText(encoder, "some words here " * 2000)
    before = long.touched
    long.replace(8000, 8004, "none")
    long.append(" end")
    assert long.touched - before < 10


def test_bpe_tables(spark, encoders):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (3, "")]
    documents = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n_tokens")
    ids = encoders[1].encode_ordinary(rows[0][1])
    found = {r.doc_id: r for r in bytepair.digests(documents, RANKS, public_tokenizers.PATTERN).collect()}
    assert found[1].n_tokens == len(ids) and found[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert found[1].decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert found[2].n_tokens == 0 and found[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    tokens = bytepair.tokens(documents, RANKS, public_tokenizers.PATTERN)
    assert [r.decoded_text for r in bytepair.decoded(tokens, RANKS).orderBy("doc_id").collect()] == ["Hello wörld", "", "", ""]
