"""Balancing the catalogue: every leaf filled to its target from old and newly listed products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shelfspark.functions.ids import leaf_target
from shelfspark.operators import leaves as L
from shelfspark.session import materialize


@dataclass
class Balance:
    """Plans of one balancing run; nothing is computed before one of them is written."""

    ranked: DataFrame
    selected: DataFrame
    report: DataFrame
    progress: DataFrame


def balance(roots: DataFrame, edges: DataFrame, old: DataFrame, listed: DataFrame, done: DataFrame,
            seed: int = 0, targets: DataFrame | None = None) -> Balance:
    """Resolve leaves, rank the unfinished ones by their old products, and fill each to its target.

    ``old`` and ``listed`` have ``product_id, leaf``. A listed product that an old record can supply counts as reused.
    ``targets`` (``leaf, target``) overrides the drawn targets.
    """
    leaves = materialize(L.resolve_leaves(roots, edges), "leaves")
    open_leaves = L.unfinished(leaves, done)
    counted = L.with_old_counts(open_leaves, L.leaf_counts(old))
    ranked = L.rank_leaves(counted)
    if targets is None:
        targets = open_leaves.select("leaf").distinct().withColumn("target", leaf_target(F.col("leaf"), seed))
    fresh = listed.join(old.select("product_id"), "product_id", "left_anti")
    wanted = L.phases(old, fresh).join(open_leaves.select("leaf").distinct(), "leaf", "left_semi")
    selected = L.fill_quota(wanted, targets, seed=seed).withColumn(
        "outcome", F.when(F.col("phase") == 1, "reused").otherwise("crawled"))
    filled = selected.groupBy("leaf", "target").agg(
        F.count(F.lit(1)).alias("filled"), F.count_if(F.col("phase") == 1).alias("reused"))
    report = (L.with_targets(open_leaves, targets, seed).join(filled.drop("target"), "leaf", "left")
              .select("root", "leaf", "target", *[
                  F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("filled", "reused")])
              .withColumn("crawled", F.col("filled") - F.col("reused")))
    finished = report.filter("filled >= target").select("leaf").unionByName(done.select("leaf")).distinct()
    state = leaves.join(finished.withColumn("_done", F.lit(True)), "leaf", "left")
    return Balance(ranked, selected, report,
                   L.progress(state.withColumn("done", F.coalesce("_done", F.lit(False)))))
