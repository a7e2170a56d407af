"""Category leaves: resolution, historic counts, quotas, keyword plans, listing pages, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfspark.functions.ids import leaf_target
from shelfspark.functions.text import last_segment, listing_url
from shelfspark.operators.ranking import counts_before, paged_lists, rank_in_group, sliced, top_per_group
from shelfspark.session import materialize, scratch_path


def resolve_leaves(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaves below each root as ``(root, leaf)``, each once.

    ``roots`` has ``root``; ``edges`` has ``parent, id, is_leaf``. A node that any of its edges flags as leaf is
    not descended into; a node without usable children is its own leaf. One join per level of the tree, however
    deep: nodes met before are not met again, so that a node with several parents counts once and a cycle ends. Children
    come by an inner join, whose skewed partitions AQE can split on either side.
    """
    spark = roots.sparkSession
    usable = edges.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    flagged = F.max(F.coalesce("is_leaf", F.lit(False))).alias("child_is_leaf")
    usable = materialize(usable.groupBy(F.col("parent").alias("node"), F.col("id").alias("child")).agg(flagged), "edges")
    path = scratch_path(spark, "leaves")
    level = roots.select("root", F.col("root").alias("node"), F.lit(False).alias("is_leaf")).distinct()
    depth = 0
    while True:
        level.write.parquet(f"{path}/level={depth}")
        visited = spark.read.schema(T.StructType([*level.schema, T.StructField("level", T.IntegerType())])).parquet(path)
        frontier = visited.filter((F.col("level") == depth) & ~F.col("is_leaf"))
        if frontier.isEmpty():
            break
        below = (frontier.select("root", "node").join(usable, "node").groupBy("root", F.col("child").alias("node"))
                 .agg(F.max("child_is_leaf").alias("is_leaf")))
        level = below.join(visited.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "is_leaf")
        depth += 1
    inner = usable.select("node").distinct()
    childless = visited.filter("NOT is_leaf").join(inner, "node", "left_anti")
    found = visited.filter("is_leaf").select("root", "node").unionByName(childless.select("root", "node"))
    return found.withColumnRenamed("node", "leaf")


def products_by_leaf(products: DataFrame, path: str = "primary_category_path") -> DataFrame:
    """Products with the leaf they belong to; those with an empty path are left out."""
    return products.withColumn("leaf", last_segment(F.col(path))).filter(F.col("leaf").isNotNull())


def leaf_index(by_leaf: DataFrame, product: str = "product_id", page_size: int = 1000) -> DataFrame:
    """Leaf -> ordered product ids, in pages: one leaf may hold any share of all products."""
    return paged_lists(by_leaf, ["leaf"], [product], F.col(product), page_size, list_col="product_ids")


def leaf_counts(by_leaf: DataFrame) -> DataFrame:
    return by_leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("old_count"))


def leaf_totals(counts: DataFrame) -> DataFrame:
    """Number of leaves and of reusable products."""
    return counts.agg(F.count(F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("old_count"), F.lit(0)).alias("reusable"))


def unfinished(leaves: DataFrame, done: DataFrame) -> DataFrame:
    return leaves.join(done.select("leaf").distinct(), "leaf", "left_anti")


def with_old_counts(leaves: DataFrame, counts: DataFrame) -> DataFrame:
    """Historic count per leaf, 0 where there is none."""
    return leaves.join(counts, "leaf", "left").withColumn("old_count", F.coalesce("old_count", F.lit(0).cast("bigint")))


def rank_leaves(counted: DataFrame) -> DataFrame:
    """1-based rank of leaves, those with most old products first."""
    return rank_in_group(counted, [], ["old_count", "leaf"], "leaf_rank", descending=["old_count"])


def top_leaves(counted: DataFrame, n: int = 10) -> DataFrame:
    """The report of the ``n`` leaves with most old products."""
    return counted.orderBy(F.desc("old_count"), "leaf").limit(n)


def phases(old: DataFrame, listed: DataFrame) -> DataFrame:
    """Reusable rows (phase 1) and newly listed rows (phase 2) in one frame."""
    return (old.withColumn("phase", F.lit(1))
            .unionByName(listed.withColumn("phase", F.lit(2)), allowMissingColumns=True))


def with_targets(leaves: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Rows with the ``target`` of their leaf; a leaf without one gets the target drawn for it, so no row is lost.

    Of several targets of a leaf the largest counts.
    """
    given = targets.groupBy("leaf").agg(F.max("target").alias("target"))
    return leaves.join(given, "leaf", "left").withColumn("target", F.coalesce("target", leaf_target(F.col("leaf"), seed)))


def quota_cuts(candidates: DataFrame, targets: DataFrame, product: str = "product_id", seed: int = 0) -> DataFrame:
    """(leaf, cut): the key (phase, product) of the last candidate taken, for each leaf with more candidates than its ``target``.

    Keys alone are dealt into slices by leaf and order. Counts of (leaf, slice), added up, say which slices lie wholly below the
    target and which one it falls into; only that slice's part of the leaf is ranked. No task sees a leaf.
    """
    keys = candidates.select("leaf", "phase", F.col(product).alias("product"))
    placed = sliced(keys, ["leaf"], [F.col("phase").asc(), F.col("product").asc()])
    counted = counts_before(placed, ["leaf"])
    totals = with_targets(counted.groupBy("leaf").agg(F.sum("_n").alias("total")), targets, seed).filter("total > target")
    # One row a leaf that is cut: the slice and the place in it.
    within = counted.join(totals.select("leaf", "target"), "leaf").filter("_before < target AND target <= _before + _n")
    wanted = within.select("leaf", "_slice", (F.col("target") - F.col("_before")).alias("place"))
    place = F.row_number().over(Window.partitionBy("_slice", "leaf").orderBy("phase", "product", "_spread"))
    last = placed.join(wanted, ["leaf", "_slice"]).withColumn("at", place).filter("at = place")
    empty = totals.filter("target <= 0").select("leaf", F.lit(None).alias("cut"), F.lit(False).alias("any"))
    return last.select("leaf", F.struct("phase", "product").alias("cut"), F.lit(True).alias("any")).unionByName(empty)


def fill_quota(candidates: DataFrame, targets: DataFrame, product: str = "product_id", seed: int = 0) -> DataFrame:
    """Candidates taken per leaf, phase 1 first, until the leaf's ``target`` is reached; exact for any leaf size.

    Rows behind the cut of their leaf are dropped where they are read; those up to it, as many as the targets allow, are ranked.
    Of candidates with one leaf, phase and product any may be the last.
    """
    cuts = materialize(quota_cuts(candidates, targets, product, seed), "cuts")
    up_to = (candidates.join(cuts, "leaf", "left")
             .filter(F.col("any").isNull() | F.col("any") & (F.struct("phase", F.col(product).alias("product")) <= F.col("cut"))).drop("cut", "any"))
    ranked = rank_in_group(up_to, ["leaf"], ["phase", product], "taken")
    return with_targets(ranked, targets, seed).filter("taken <= target")


def leaf_keywords(leaves: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every leaf with each keyword of its root, in their order; a root without keywords gives one empty keyword.

    ``keywords`` is the fixed dimension ``(root, keywords)`` with one row per root.
    """
    joined = leaves.join(keywords, "root", "left")
    options = F.when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, F.col("keywords")).otherwise(F.array(F.lit("")))
    return joined.select("root", "leaf", F.posexplode(options).alias("keyword_idx", "keyword"))


def fetch_list(leaf_keyword: DataFrame, endpoint: str, page: Column) -> DataFrame:
    return leaf_keyword.withColumn("url", listing_url(endpoint, F.col("leaf"), F.col("keyword"), page))


def page_cursors(listings: DataFrame, order: list[str], page_size: int = 40) -> DataFrame:
    """Pages a landed listing fills: number of rows and pages, and rows on the last page, per leaf. ``order`` is that of the pages."""
    pages = F.ceil(F.col("n_rows") / page_size).cast("bigint")
    return (listings.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumns({"n_pages": pages,
                          "last_page_rows": F.col("n_rows") - (F.greatest(pages, F.lit(1)) - 1) * page_size}))


def listing_pages(listings: DataFrame, order: list[str], page_size: int = 40) -> DataFrame:
    """Each landed listing row with its 1-based page."""
    ranked = rank_in_group(listings, ["leaf"], order, "_rank")
    return ranked.withColumn("page", F.ceil(F.col("_rank") / page_size).cast("bigint")).drop("_rank")


def next_cursor(fetched: DataFrame) -> DataFrame:
    """Cursor per ``(leaf, keyword)`` after a fetch log with ``page, n_rows, failed``.

    -1 once a page came back empty; a failed request neither advances nor exhausts the keyword.
    """
    served = ~F.col("failed")
    exhausted = F.max(served & (F.col("n_rows") == 0))
    last = F.max(F.when(served & (F.col("n_rows") > 0), F.col("page")))
    return fetched.groupBy("leaf", "keyword").agg(
        F.when(F.coalesce(exhausted, F.lit(False)), F.lit(-1).cast("bigint"))
        .otherwise(F.coalesce(last, F.lit(0)).cast("bigint") + 1).alias("next_page"))


def progress(leaves: DataFrame, done: str = "done", group: str = "root") -> DataFrame:
    """Total, completed and remaining leaves and the percentage done, per root."""
    grouped = leaves.groupBy(group).agg(
        F.count("leaf").alias("total"), F.count_if(F.col(done) & F.col("leaf").isNotNull()).alias("completed"))
    percent = F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(F.lit(100.0))
    return grouped.withColumns({"remaining": F.col("total") - F.col("completed"), "percent": percent})


def newest_state(state_log: DataFrame) -> DataFrame:
    """Latest saved state per leaf from a log of ``(leaf, saved_at, …)``."""
    return top_per_group(state_log, ["leaf"], [F.desc("saved_at")])
