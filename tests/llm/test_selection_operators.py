"""Resampling, centroid clustering and URL filters against brute force and on defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfspark.llm import centroids, resample, suite, urlfilter

SF_DIR = "/root/testdata/sf0.001"


# -- resampling

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, longest=3):
    words = _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def _bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def _resampled(rows, target, percent=5, min_words=20):
    """By the definition: rows (doc_id, n_features, weight, score, rank)."""
    read = [(doc, *_features(text)) for doc, text in rows]
    s = Counter(_bucket(f) for _, _, found in read for f in found)
    t = Counter(_bucket(f) for text in target for f in _features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for doc, words, found in read:
        weight = sum(gain[_bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    eligible = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, row in enumerate(eligible[:percent * len(eligible) // 100], 1):
        row[4] = rank
    return sorted(str(tuple(r[:5])) for r in out)


def test_features_of_stretches_are_those_of_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abZ9 .é\x00漢-") for _ in range(rng.randint(0, 60)))
        for piece in (1, 7, 1 << 18):
            found = list(resample.feature_hashes(text, 3, piece))
            words, features = _features(text)
            assert sum(n for n, _ in found) == len(words)
            assert Counter(int(h) for _, hashes in found for h in hashes) == Counter(zlib.crc32(f.encode()) for f in features)


def test_draws_equal_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rows, target = [(r.doc_id, r.text) for r in documents.collect()], [r.text for r in benchmark.collect()]
    assert sorted(str(tuple(r)) for r in suite.op11_resample(spark, SF_DIR).collect()) == _resampled(rows, target)
    kept = resample.resample(documents.selectExpr("*", "1 as _score", "2 as _rank"), benchmark, percent=10)
    expected = {r[0] for r in map(eval, _resampled(rows, target, 10)) if r[4]}  # noqa: S307 - tuples of numbers
    assert {r.doc_id for r in kept.collect()} == expected and kept.columns == [*documents.columns, "_score", "_rank"]


def test_draws_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(25))
    rows = [(1, None), (2, ""), (None, long), (None, long), (3, long + " more"), (3, long + " more"), (4, "few words"), (5, "... --"), (6, long.upper())] + [(7, long)] * 12
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "3 as _first", "4 as n_words")
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    for percent in (0, 60, 100):
        found = resample.ranked(table, target, percent=percent)
        assert sorted(str(tuple(r)) for r in found.collect()) == _resampled(rows, ["w1 w2", None], percent)
        assert resample.resample(table, target, percent=percent).count() == percent * 17 // 100
    assert resample.ranked(table.limit(0), target).count() == 0
    assert resample.ranked(table, target.limit(0)).count() == len(rows)


def test_quickselect_finds_every_key(spark):
    rng = random.Random(3)
    values = [(rng.choice([None, *range(6)]), rng.choice("ab")) for _ in range(120)]
    rows = spark.createDataFrame(values, "a int, b string").repartition(5)
    order = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    for k in (1, 60, 120):
        assert resample.kth_key(rows, ["a", "b"], k, pivots=2) == order[k - 1]
    with pytest.raises(ValueError):
        resample.kth_key(rows, ["a", "b"], 121)


# -- centroid clustering

def _lloyd(points, first, rounds):
    found = [list(c) for c in first]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(found)) for p in points]
        if turn < rounds:
            for j in range(len(found)):
                if mine := [p for p, (_, k) in zip(points, own, strict=True) if k == j]:
                    found[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return own, found


@pytest.mark.parametrize("spread", [1, 40, 3000])
def test_bounds_keep_the_clusters_of_plain_rounds(spread):
    """Clustered points, many ties and copies; and bounds that are looked at again far less often than there are distances."""
    rng = np.random.default_rng(spread)
    middles = rng.integers(-10_000, 10_000, size=(5, 6))
    points = middles[rng.integers(0, 5, size=600)] + rng.integers(-spread, spread + 1, size=(600, 6))
    points[100:200] = points[0]
    points[200:230] = (points[300] + points[301]) // 2
    history, rounds = points[None, [0, 300, 301, 302, 303, 304]], 8
    bounds = centroids.Bounds.unknown(points, 6)
    for turn in range(rounds + 1):
        bounds.assign(history)
        if turn < rounds:
            means = [points[bounds.cluster == j].sum(axis=0) // max(1, (bounds.cluster == j).sum()) if (bounds.cluster == j).any() else history[-1][j] for j in range(6)]
            history = np.concatenate([history, np.array(means)[None]])
    own, found = _lloyd(points.tolist(), history[0].tolist(), rounds)
    assert bounds.cluster.tolist() == [j for _, j in own] and history[-1].tolist() == found
    if spread < 3000:
        assert bounds.evaluated.sum() < 0.5 * 600 * 6 * (rounds + 1)


def test_bounds_go_by_the_whole_displacement():
    """A centroid that goes away and comes back has drifted by nothing, however long its way was."""
    points = np.array([[0, 0]])
    bounds = centroids.Bounds.unknown(points, 2)
    places = [[[0, 1], [0, 10 + 6 * (k % 2)]] for k in range(8)]
    for now in range(8):
        bounds.assign(np.array(places[:now + 1]))
    assert bounds.evaluated.tolist() == [2] and bounds.cluster.tolist() == [0]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as point", "3 as id", "4 as distance")


def test_clusters_of_odd_rows(spark):
    rng = random.Random(7)
    good = [(k % 30 if k % 9 else None, [rng.choice([-1.5, 0.0, 0.25, 2.0, 1e-5]) for _ in range(3)]) for k in range(80)] + [(99, [0.0, 0.0, 0.0])] * 5
    bad = [(200, None), (201, [1.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (204, [None, 0.0, 0.0]), (205, []), (206, [1.0] * 4)]
    found = centroids.clustered(_vectors(spark, good + bad), clusters=4, rounds=3, seed=3, size=3)
    points = [[math.floor(1024 * x) for x in v] for _, v in good]
    first = sorted(range(len(good)), key=lambda k: (good[k][0] is None, hashlib.sha256(f"3:{good[k][0]}".encode()).hexdigest() if good[k][0] is not None else "", points[k]))
    own, centres = _lloyd(points, [points[k] for k in first[:4]], 3)
    inertia = [sum(d for d, k in own if k == j) for j in range(4)]
    expected = [(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(good, own, strict=True)]
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(map(str, expected))


def test_few_vectors_and_none(spark):
    assert centroids.clustered(_vectors(spark, [(1, [1.0, 2.0])] * 2), size=2).select("distance", "inertia").distinct().collect() == [(0, 0)]
    assert centroids.clustered(_vectors(spark, []), size=2).count() == 0
    assert centroids.clustered(_vectors(spark, [(1, None)]), size=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for far in (1e6, -1e30):
        with pytest.raises(Exception, match="a component of"):
            centroids.clustered(_vectors(spark, [(1, [far, 2.0])]), size=2).collect()


# -- URL filters

RULES = [urlfilter.Site("allow", "com"), urlfilter.Site("block", "Example.com", "/en/"), urlfilter.Site("block", "a.b", "/x"), urlfilter.Site("allow", "b", "/xy/z"),
         urlfilter.Pattern("block", "||ads.*/pop^"), urlfilter.Pattern("block", "track"), urlfilter.Pattern("allow", "|good.org/*track|"), urlfilter.Pattern("block", "/Ünï*"),
         urlfilter.Pattern("block", "^id=7^")]


def _verdict(url):
    """By the definition, rule by rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    tail = rest[len(host):]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    path = re.match("[^?#]*", tail)[0]
    sites = [(len(r.name), len(r.host), r.name, r.verdict) for r in RULES if isinstance(r, urlfilter.Site)
             and (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    if sites:
        return host, path, max(sites)[2], None, max(sites)[3]
    patterns = []
    for rule in RULES:
        if isinstance(rule, urlfilter.Pattern):
            body, whole = rule.text.strip("|"), host + tail
            inner = "".join(".*" if c == "*" else "(?:[^A-Za-z0-9_.%-]|\\Z)" if c == "^" else re.escape(c) for c in body)
            front = "(?:[^/?#]*\\.)?" if rule.text.startswith("||") else "" if rule.text.startswith("|") else ".*"
            if re.compile(front + inner + ("\\Z" if rule.text.endswith("|") else ""), re.S | re.I).match(whole):
                patterns.append((rule.verdict == "allow", len(rule.text), rule.text, rule.verdict))
    return host, path, None, *(max(patterns)[2:] if patterns else (None, "allow"))


def test_verdicts_equal_rule_by_rule(spark):
    rng = random.Random(5)
    parts = ["com", "example.com", "www.EXAMPLE.com", "a.b", "b", "ads.net", "xads.net", "good.org", "x", "/en/", "/EN/", "/x", "/xy/z", "/pop", "/popx", "track", "tracker", "/Ünï9",
             "?id=7", "&id=7", "#top", "?", "é", ".", ":80", "\n"]
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "x://y://com/", "http:///en/", "ftp://a.b/xy/z"]
    urls += ["http://" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(1500)] + ["http://ads.net/pop"] * 5
    rows = [(k if k % 7 else None, u) for k, u in enumerate(urls)] + [(1, "http://ads.net/pop")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as token", "3 as rank", "'h' as _blocked", "4 as address")
    found = urlfilter.judge(pages, RULES)
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(str((k, *_verdict(u))) for k, u in rows)
    kept = urlfilter.keep_allowed(pages, RULES)
    assert kept.columns == pages.columns
    assert sorted(str((r.page_id, r.url)) for r in kept.collect()) == sorted(str((k, u)) for k, u in rows if _verdict(u)[-1] == "allow")
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0 and urlfilter.judge(pages, []).filter("verdict = 'allow'").count() == len(rows)


def test_rules_are_indexed_by_their_rarest_token(spark):
    table = urlfilter.rule_table(spark, RULES)
    addresses = spark.createDataFrame([("example.com/en/",)] * 3 + [("ads.com/en/pop/xy",)] * 2 + [("b",)], "address string")
    tokens = {r.name: r.token for r in urlfilter.rarest_tokens(table, addresses).join(table, "rank").collect()}
    # The last token of an open end, as that of "/xy/z", or one beside an asterisk may go on and finds nothing.
    assert tokens == {"com/": "com", "example.com/en/": "example", "a.b/x": "a", "b/xy/z": "b", "||ads.*/pop^": "ads", "track": "", "|good.org/*track|": "good", "/Ünï*": "n",
                      "^id=7^": "7"}
    with pytest.raises(ValueError):
        urlfilter.rule_table(spark, [urlfilter.Site("allow", "a"), urlfilter.Site("block", "a")])


def test_regular_expressions_run_on_candidates_only(spark):
    plan = urlfilter.judge(spark.read.parquet(f"{SF_DIR}/pages.parquet"), RULES)._jdf.queryExecution().executedPlan().toString()
    above, below = re.split(r"HashJoin \[token#\d+\], \[token#\d+\], Inner", plan, maxsplit=1)
    assert "RLIKE" in above and "RLIKE" not in below and "html" not in plan and "Python" not in plan
