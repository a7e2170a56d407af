"""Queries over category leaves, quotas and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions.ids import leaf_target
from shelfspark.operators import leaves as L
from shelfspark.plans.balancing import balance
from shelfspark.suite.adapters import cte, edges, roots, table, view


def leaf_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return L.resolve_leaves(roots(spark, sf), edges(spark, sf))


def _by_leaf(spark, sf):
    return L.products_by_leaf(view(spark, sf, "old_products"))


# All customers in chains of forty below one root; the last of each chain has two parents.
_CHAIN = """SELECT CASE WHEN c_custkey % 40 = 0 OR c_custkey = 1 THEN 'T' ELSE concat('C', c_custkey - 1) END AS parent, concat('C', c_custkey) AS id FROM customer
    UNION ALL SELECT concat('C', c_custkey - 2), concat('C', c_custkey) FROM customer WHERE c_custkey % 40 = 39"""


def leaf_resolve_deep(spark, sf):
    links = spark.sql(_CHAIN.replace("customer", "{customer}"), customer=table(spark, sf, "customer"))
    return L.resolve_leaves(spark.range(1).select(F.lit("T").alias("root")), links.withColumn("is_leaf", F.lit(False)))


def leaf_index(spark, sf):
    pages = L.leaf_index(_by_leaf(spark, sf), page_size=25)
    return pages.select("leaf", "page", F.concat_ws(",", "product_ids").alias("product_ids"))


def _counted(spark, sf):
    nations = table(spark, sf, "nation").selectExpr("concat('N', n_nationkey) AS leaf").unionByName(
        table(spark, sf, "region").selectExpr("concat('E', r_regionkey) AS leaf"))
    return L.with_old_counts(nations, L.leaf_counts(_by_leaf(spark, sf)))


def leaf_counts_ranked(spark, sf):
    return L.rank_leaves(_counted(spark, sf))


def leaf_top10(spark, sf):
    return L.top_leaves(_counted(spark, sf))


def leaf_totals(spark, sf):
    return L.leaf_totals(L.leaf_counts(_by_leaf(spark, sf)))


def leaf_targets(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", leaf_target(F.col("c_custkey")).alias("target"))


def _phases(spark, sf):
    """Old products of some market segments, listed ones of the others."""
    rows = _by_leaf(spark, sf).withColumn("product_id", F.lpad("product_id", 12, "0"))
    is_old = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return (rows.filter(is_old).select("leaf", "product_id"), rows.filter(~is_old).select("leaf", "product_id", "c_acctbal"))


def _targets(spark, sf):
    return table(spark, sf, "nation").selectExpr("concat('N', n_nationkey) AS leaf", "cast(10 + 9 * n_regionkey AS bigint) AS target")


def leaf_quota(spark, sf):
    filled = L.fill_quota(L.phases(*_phases(spark, sf)), _targets(spark, sf))
    return filled.select("leaf", "product_id", F.col("phase").cast("bigint").alias("phase"), "taken", F.round("c_acctbal", 2).alias("c_acctbal"))


def quota_without_target(spark, sf):
    """Only some leaves have a target; the others get the one drawn for them."""
    filled = L.fill_quota(L.phases(*_phases(spark, sf)), _targets(spark, sf).filter("target < 30"))
    return filled.select("leaf", "product_id", "target", "taken")


def leaf_quota_hot(spark, sf):
    """All order lines as candidates of five leaves, one of them with half of the rows, targets as large as real ones."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) AS leaf", "CASE WHEN l_linenumber > 4 THEN 1 ELSE 2 END AS phase", "l_orderkey * 10 + l_linenumber AS product_id")
    targets = lines.select("leaf").distinct().withColumn("target", F.when(F.col("leaf") == "NF", 40).otherwise(1100).cast("bigint"))
    filled = L.fill_quota(lines, targets)
    return filled.select("leaf", F.col("phase").cast("bigint").alias("phase"), "product_id", "taken")


def leaf_keywords(spark, sf):
    """Every customer leaf with the keywords of its root; the last region has none."""
    leaves = (table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey"))
              .select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("root"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("leaf")))
    words = (table(spark, sf, "part").withColumn("root", F.concat(F.lit("R"), (F.col("p_size") % 4).cast("string")))
             .groupBy("root").agg(F.sort_array(F.collect_set("p_name")).alias("keywords")))
    asked = L.leaf_keywords(leaves, words)
    return L.fetch_list(asked, "https://shop.example.com/listings", F.lit(1)).select(
        "root", "leaf", F.col("keyword_idx").cast("bigint").alias("keyword_idx"), "keyword", "url")


def leaf_progress(spark, sf):
    """Orders as leaves of their customer's nation, done when finished; nations without orders are complete."""
    nations = table(spark, sf, "nation")
    owners = table(spark, sf, "customer").join(nations, F.expr("n_nationkey = c_nationkey"))
    leaves = (table(spark, sf, "orders").join(owners, F.expr("o_custkey = c_custkey"))
              .select(F.col("n_name").alias("root"), F.col("o_orderkey").alias("leaf"), F.expr("o_orderstatus = 'F'").alias("done")))
    return L.progress(leaves.unionByName(nations.select(F.col("n_name").alias("root")), allowMissingColumns=True)).withColumn("percent", F.round("percent", 6))


def leaves_left(spark, sf):
    orders = table(spark, sf, "orders")
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("leaf"))
    return L.unfinished(table(spark, sf, "customer").select(F.col("c_custkey").alias("leaf"), "c_name"), done)


def _listings(spark, sf):
    return table(spark, sf, "customer").selectExpr("concat('N', c_nationkey) AS leaf", "c_custkey")


def listing_pages(spark, sf):
    return L.listing_pages(_listings(spark, sf), ["c_custkey"])


def page_cursors(spark, sf):
    return L.page_cursors(_listings(spark, sf), ["c_custkey"])


def next_cursor(spark, sf):
    """Events as a fetch log: the user stands for the leaf, the type for the keyword."""
    log = table(spark, sf, "events").selectExpr(
        "user_id AS leaf", "event_type AS keyword", "event_id AS page", "cast(floor(value) AS bigint) AS n_rows", "value > 60 AS failed")
    return L.next_cursor(log)


def saved_state(spark, sf):
    log = table(spark, sf, "events").selectExpr("user_id AS leaf", "event_id AS saved_at", "event_type AS state")
    return L.newest_state(log)


def _balance(spark, sf):
    """Nations as leaves; a customer is old stock of its nation if its segment says so, else a listing."""
    leaf_edges = edges(spark, sf).filter("NOT is_leaf")
    old, listed = _phases(spark, sf)
    done = table(spark, sf, "nation").filter("n_nationkey >= 20").selectExpr("concat('N', n_nationkey) AS leaf")
    return balance(roots(spark, sf), leaf_edges, old, listed.drop("c_acctbal"), done, targets=_targets(spark, sf))


def balance_report(spark, sf):
    return _balance(spark, sf).report


def balance_selected(spark, sf):
    return _balance(spark, sf).selected.select("leaf", "product_id", "outcome")


def balance_progress(spark, sf):
    return _balance(spark, sf).progress.withColumn("percent", F.round("percent", 6))


QUERIES = {f.__name__: f for f in (
    leaf_resolve, leaf_resolve_deep, quota_without_target, leaf_quota_hot, leaf_index, leaf_counts_ranked, leaf_top10, leaf_totals, leaf_targets, leaf_quota, leaf_keywords,
    leaf_progress, leaves_left, listing_pages, page_cursors, next_cursor, saved_state, balance_report,
    balance_selected, balance_progress)}

_DRAWN = "9000 + (('0x' || substr(md5({} || ':0'), 1, 16))::ubigint % 9223372036854775808)::bigint % 2001"
_BY_LEAF = """by_leaf AS (SELECT *, split_part(primary_category_path, '/', 2) AS leaf FROM old_products WHERE primary_category_path <> '')"""
_COUNTED = """counted AS (SELECT l.leaf, count(b.product_id) AS old_count FROM (SELECT concat('N', n_nationkey) AS leaf FROM nation
    UNION ALL SELECT concat('E', r_regionkey) FROM region) l LEFT JOIN by_leaf b ON b.leaf = l.leaf GROUP BY l.leaf)"""
_TAKEN = """cand AS (SELECT leaf, lpad(product_id, 12, '0') AS product_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 2 END::bigint AS phase,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN round(c_acctbal, 2) END AS c_acctbal FROM by_leaf),
    targets AS (SELECT concat('N', n_nationkey) AS leaf, (10 + 9 * n_regionkey)::bigint AS target, n_nationkey, n_regionkey FROM nation),
    taken AS (SELECT c.*, target, n_nationkey, row_number() OVER (PARTITION BY c.leaf ORDER BY phase, product_id) AS taken
        FROM cand c JOIN targets t ON t.leaf = c.leaf)"""
_FILLED = """filled AS (SELECT concat('R', n_regionkey) AS root, t.leaf, t.target, count(k.product_id) AS filled, count(*) FILTER (k.phase = 1) AS reused
        FROM targets t LEFT JOIN (SELECT * FROM taken WHERE taken <= target) k ON k.leaf = t.leaf
        WHERE t.n_nationkey < 20 GROUP BY ALL)"""

ORACLE = {
    "leaf_resolve": cte("edges") + """, down AS (SELECT concat('R', r_regionkey) AS root, concat('R', r_regionkey) AS node, false AS is_leaf FROM region
            UNION ALL SELECT d.root, e.id, e.is_leaf FROM down d JOIN edges e ON e.parent = d.node WHERE NOT d.is_leaf AND e.id <> '')
        SELECT root, node AS leaf FROM down d WHERE is_leaf OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.parent = d.node AND e.id <> '')""",
    "leaf_resolve_deep": f"""WITH RECURSIVE links AS ({_CHAIN}), down AS (SELECT 'T' AS node UNION SELECT id FROM down JOIN links ON parent = node)
        SELECT 'T' AS root, node AS leaf FROM down WHERE NOT EXISTS (SELECT 1 FROM links WHERE parent = node)""",
    "leaf_quota_hot": """SELECT * FROM (SELECT leaf, phase, product_id, row_number() OVER (PARTITION BY leaf ORDER BY phase, product_id) AS taken FROM (
        SELECT l_returnflag || l_linestatus AS leaf, CASE WHEN l_linenumber > 4 THEN 1 ELSE 2 END::bigint AS phase, l_orderkey * 10 + l_linenumber AS product_id FROM lineitem))
        WHERE taken <= CASE WHEN leaf = 'NF' THEN 40 ELSE 1100 END""",
    "quota_without_target": cte("old_products") + f""", {_BY_LEAF}, {_TAKEN} SELECT leaf, product_id, target, taken FROM (
        SELECT leaf, product_id, taken, CASE WHEN target < 30 THEN target ELSE {_DRAWN.format('leaf')} END AS target FROM taken) WHERE taken <= target""",
    "leaf_index": cte("old_products") + f""", {_BY_LEAF} SELECT leaf, page, string_agg(product_id, ',' ORDER BY product_id) AS product_ids
        FROM (SELECT *, (row_number() OVER (PARTITION BY leaf ORDER BY product_id) + 24) // 25 AS page FROM by_leaf) GROUP BY leaf, page""",
    "leaf_counts_ranked": cte("old_products") + f", {_BY_LEAF}, {_COUNTED} SELECT *, row_number() OVER (ORDER BY old_count DESC, leaf) AS leaf_rank FROM counted",
    "leaf_top10": cte("old_products") + f", {_BY_LEAF}, {_COUNTED} SELECT * FROM counted ORDER BY old_count DESC, leaf LIMIT 10",
    "leaf_totals": cte("old_products") + f", {_BY_LEAF} SELECT count(DISTINCT leaf) AS n_leaves, count(*) AS reusable FROM by_leaf",
    "leaf_targets": """SELECT c_custkey, 9000 + (('0x' || substr(md5(concat(c_custkey, ':0')), 1, 16))::ubigint % 9223372036854775808)::bigint % 2001 AS target FROM customer""",
    "leaf_quota": cte("old_products") + f", {_BY_LEAF}, {_TAKEN} SELECT leaf, product_id, phase, taken, c_acctbal FROM taken WHERE taken <= target",
    "leaf_keywords": """WITH words AS (SELECT concat('R', p_size % 4) AS root, p_name AS keyword, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_name) - 1 AS keyword_idx
            FROM (SELECT DISTINCT p_size % 4 AS p_size, p_name FROM part)),
        leaves AS (SELECT concat('R', n_regionkey) AS root, concat('C', c_custkey) AS leaf FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT l.root, leaf, coalesce(keyword_idx, 0) AS keyword_idx, coalesce(keyword, '') AS keyword,
            'https://shop.example.com/listings?limit=40' || coalesce('&q=' || replace(keyword, ' ', '+'), '') || '&category=' || leaf || '&page=1' AS url
        FROM leaves l LEFT JOIN words w ON w.root = l.root""",
    "leaf_progress": """SELECT root, total, completed, total - completed AS remaining, CASE WHEN total > 0 THEN round(completed / total * 100, 6) ELSE 100.0 END AS percent
        FROM (SELECT n_name AS root, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed
              FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name)""",
    "leaves_left": "SELECT c_custkey AS leaf, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "listing_pages": """SELECT concat('N', c_nationkey) AS leaf, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 39) // 40 AS page FROM customer""",
    "page_cursors": """SELECT concat('N', c_nationkey) AS leaf, count(*) AS n_rows, (count(*) + 39) // 40 AS n_pages,
        count(*) - ((count(*) + 39) // 40 - 1) * 40 AS last_page_rows FROM customer GROUP BY c_nationkey""",
    "next_cursor": """SELECT user_id AS leaf, event_type AS keyword, CASE WHEN count(*) FILTER (value <= 60 AND floor(value) = 0) > 0 THEN -1
        ELSE coalesce(max(event_id) FILTER (value <= 60 AND floor(value) > 0), 0) + 1 END AS next_page FROM events GROUP BY user_id, event_type""",
    "saved_state": """SELECT leaf, saved_at, state FROM (SELECT user_id AS leaf, event_id AS saved_at, event_type AS state,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "balance_report": cte("old_products") + f""", {_BY_LEAF}, {_TAKEN}, {_FILLED} SELECT root, leaf, target, filled, reused, filled - reused AS crawled FROM filled
        UNION ALL SELECT concat('R', r_regionkey), concat('E', r_regionkey), {_DRAWN.format("concat('E', r_regionkey)")}, 0, 0, 0 FROM region""",
    "balance_selected": cte("old_products") + f""", {_BY_LEAF}, {_TAKEN} SELECT leaf, product_id, CASE phase WHEN 1 THEN 'reused' ELSE 'crawled' END AS outcome
        FROM taken WHERE taken <= target AND n_nationkey < 20""",
    "balance_progress": cte("old_products") + f""", {_BY_LEAF}, {_TAKEN}, {_FILLED}, state AS (
            SELECT concat('R', n_regionkey) AS root, t.leaf, t.n_nationkey >= 20 OR coalesce(f.filled >= t.target, false) AS done
            FROM targets t LEFT JOIN filled f ON f.leaf = t.leaf UNION ALL SELECT concat('R', r_regionkey), concat('E', r_regionkey), false FROM region)
        SELECT root, count(*) AS total, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS remaining,
               round(count(*) FILTER (done) / count(*) * 100, 6) AS percent FROM state GROUP BY root""",
}
