"""The registered queries of the corpus operators, one per operator, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm import (
    blockjoin, bytepair, centroids, chat, decontaminate, licences, pii, resample, simhash, tokenfiles, toxicity, urlfilter, warczip)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_toxicity(spark, sf):
    """Toxicity score of every document."""
    documents = table(spark, sf, "documents")
    model = toxicity.fit(documents, table(spark, sf, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text", "lang"), model, "score", "toxic_by_language")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_by_language")


def op2_warczip(spark, sf):
    """Every page as a WARC record, written to ZIP packages and read back."""
    return warczip.archived(spark, table(spark, sf, "pages"), least_bytes=0)


def op3_blockjoin(spark, sf):
    """The ten nearest other vectors of every hundredth vector."""
    vectors = table(spark, sf, "embeddings")
    return blockjoin.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op4_simhash(spark, sf):
    """Near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, radius=2)


def op5_decontaminate(spark, sf):
    """Every document passage that overlaps a benchmark item."""
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_pii(spark, sf):
    """Personal data in every document."""
    return pii.report(table(spark, sf, "documents"))


def op7_bytepair(spark, sf):
    """Tokens of every document, and their text again."""
    return bytepair.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_licences(spark, sf):
    """The licence every document is, and those its lines name."""
    return licences.scan(table(spark, sf, "documents"), licences.known_digests(spark))


def op9_tokenfiles(spark, sf):
    """Where every document's ids lie, read back from the written files."""
    return tokenfiles.stored_ids(spark, table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat(spark, sf):
    """Every conversation repaired and rendered, a fragment a turn."""
    return chat.format_conversations(table(spark, sf, "conversations"))


def op11_resample(spark, sf):
    """Every document's weight and score towards the benchmark, and the rank of those drawn."""
    return resample.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), percent=5, min_words=20, seed=42)


def op12_centroids(spark, sf):
    """The cluster of every vector."""
    return centroids.clustered(table(spark, sf, "embeddings"), clusters=8, rounds=10, seed=3, size=64, scale=1024)


#: Sites of the contract, and patterns for hosts and pages that no corpus wants.
URL_RULES = (
    urlfilter.Site("allow", "com"), urlfilter.Site("block", "example.com", "/en/"), urlfilter.Site("allow", "www.example.com", "/en/"),
    urlfilter.Site("block", "net", "/es/"), urlfilter.Site("block", "net", "/fr/"),
    *(urlfilter.Pattern("block", text) for text in (
        "||casino-*.", "||free-bets.", "||adult-x.", "||cheap-pills.", "||spam-farm.", "||ads-track.", "^popunder^", "/redirect?*url=http")),
    urlfilter.Pattern("allow", "||example.org/*/help."),
)


def op13_urlfilter(spark, sf):
    """The verdict on every page's address, by sites and patterns."""
    return urlfilter.judge(table(spark, sf, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_warczip, op3_blockjoin, op4_simhash, op5_decontaminate, op6_licences, op7_bytepair, op8_pii, op9_tokenfiles, op10_chat,
    op11_resample, op12_centroids, op13_urlfilter)}


def _canonical_sql(text: str) -> str:
    """The canonical form of a licence text, in SQL."""
    bare = f"regexp_replace({text}, '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    form = f"trim(regexp_replace(lower({bare}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for pattern, word in licences.EQUIVALENT_SPELLINGS:
        form = f"regexp_replace({form}, '\\b{pattern}\\b', '{word}', 'g')"
    return form


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in licences.KNOWN_TEXTS.items() for text in texts)


def _centroids_sql(rounds: int = 10) -> str:
    """Lloyd's rounds, one after the other."""
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS point
            FROM embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) = 0
            AND list_count(embedding) = 64)""",
             """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), point) - 1)::integer AS cluster, point FROM v
            ORDER BY cluster LIMIT 8)"""]
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(point) AS point, min(near).cluster AS cluster, min(near).distance AS distance
            FROM (SELECT v.n, v.vec_id, v.point, {{'distance': list_sum(list_transform(list_zip(v.point, c.point),
            lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'cluster': c.cluster}} AS near FROM v, c{turn} c) GROUP BY n)""")
        if turn < rounds:
            steps.append(f"""c{turn + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.point, c.point) AS point FROM c{turn} c LEFT JOIN (
            SELECT cluster, list(((total - ((total % size) + size) % size) // size)::bigint ORDER BY place) AS point FROM (
            SELECT cluster, place, sum(x)::bigint AS total, count(*) AS size FROM (
            SELECT cluster, unnest(point) AS x, generate_subscripts(point, 1) AS place FROM a{turn}) GROUP BY cluster, place) GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::bigint AS cluster_inertia,
        (sum(distance) OVER ())::bigint AS inertia, sha256(list_aggregate(c.point, 'string_agg', ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLE: dict[str, str] = {
    "op12_centroids": _centroids_sql(),
    "op13_urlfilter": r"""WITH parsed AS (SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '^[^/?#]*', '') AS tail
            FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
        sites(site_host, site_path, site_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        patterns(text, pattern_verdict, regex) AS (VALUES ('||casino-*.', 'block', '(?is)^([^/?#]*\.)?casino-.*\.'), ('||free-bets.', 'block', '(?is)^([^/?#]*\.)?free-bets\.'),
            ('||adult-x.', 'block', '(?is)^([^/?#]*\.)?adult-x\.'), ('||cheap-pills.', 'block', '(?is)^([^/?#]*\.)?cheap-pills\.'),
            ('||spam-farm.', 'block', '(?is)^([^/?#]*\.)?spam-farm\.'), ('||ads-track.', 'block', '(?is)^([^/?#]*\.)?ads-track\.'),
            ('^popunder^', 'block', '(?is)[^a-z0-9_.%-]popunder([^a-z0-9_.%-]|$)'), ('/redirect?*url=http', 'block', '(?is)/redirect\?.*url=http'),
            ('||example.org/*/help.', 'allow', '(?is)^([^/?#]*\.)?example\.org/.*/help\.')),
        by_site AS (SELECT n, arg_max({'name': site_host || site_path, 'verdict': site_verdict}, length(site_host || site_path) * 1000 + length(site_host)) AS s
            FROM parsed JOIN sites ON (host = site_host OR ends_with(host, '.' || site_host)) AND starts_with(path, site_path) GROUP BY n),
        by_pattern AS (SELECT n, max({'allows': pattern_verdict = 'allow', 'size': length(text), 'name': text, 'verdict': pattern_verdict}) AS p
            FROM parsed JOIN patterns ON regexp_matches(host || tail, regex) GROUP BY n)
        SELECT page_id, host, path, s.name AS rule, CASE WHEN s IS NULL THEN p.name END AS pattern, coalesce(s.verdict, p.verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN by_site USING (n) LEFT JOIN by_pattern USING (n)""",
    "op3_blockjoin": """SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.embedding::double[], c.embedding::double[]),
                lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
            FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 10""",
    "op6_licences": f"""WITH known AS (SELECT min(licence) AS licence, form FROM (SELECT licence, {_canonical_sql('body')} AS form
            FROM (VALUES {_KNOWN}) t(licence, body)) GROUP BY form),
        units AS (SELECT doc_id, 0 AS place, text AS unit FROM documents UNION ALL
            SELECT doc_id, 1, unnest(string_split_regex(text, '\r?\n')) FROM documents),
        named AS (SELECT doc_id, place, licence FROM (SELECT doc_id, place, {_canonical_sql('unit')} AS form FROM units
            WHERE regexp_matches(unit, '{licences.CUE}')) JOIN known USING (form))
        SELECT d.doc_id, max(licence) FILTER (place = 0) AS licence, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (place = 1), '') AS notices,
            count(licence) FILTER (place = 1) AS n_notices FROM documents d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id""",
}
