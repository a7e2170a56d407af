"""Keyed merges: upsert, insert-if-absent, reuse of old rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.operators.ranking import top_per_group


def fold_changes(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Current row per key from a log of changes: per column, the newest value that is not null.

    ``version`` must order the changes of one key totally. ``max_by`` folds on the map side, so
    a key with very many changes reaches the reducer as one row per map task.
    """
    order = F.struct(*version) if len(version) > 1 else F.col(version[0])
    rest = [c for c in df.columns if c not in keys and c not in version]
    return df.groupBy(*keys).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest])


def fold_rows(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Current row per key from a log of changes: the newest row as a whole, so that its columns belong together."""
    rest = [c for c in df.columns if c not in keys and c not in version]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def ordered_columns(df: DataFrame, but: Sequence[str]) -> list[str]:
    """Columns that have an order, without those of ``but``."""
    return [name for name, kind in df.dtypes if name not in but and not any(t in kind for t in ("map<", "variant"))]


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order``, or by all columns that have an order."""
    by = list(order) or ordered_columns(df, keys) or list(keys)
    return top_per_group(df, list(keys), [F.col(c).asc_nulls_last() for c in by])


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """``new`` over ``base``: its non-null fields override, absent ones survive, unknown keys are added.

    ``base`` has one row per key, and so must ``new`` have, unless ``version`` orders its changes; they are
    folded first then. Either way the join meets each key once per side and cannot be skewed.
    """
    changes = fold_changes(new, keys, version) if version else new
    joined = base.alias("b").join(changes.alias("n"), list(keys), "full_outer")
    columns = []
    for name in [*base.columns, *[c for c in changes.columns if c not in base.columns]]:
        if name in keys:
            columns.append(F.col(name))
        elif name in base.columns and name in changes.columns:
            columns.append(overlay(F.col(f"n.{name}"), F.col(f"b.{name}")).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def absent_from(new: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target`` yet.

    The keys are made distinct first: one that fills ``target`` shrinks before the shuffle, which the join shares.
    """
    return new.join(target.select(*keys).distinct(), list(keys), "left_anti")


def reusable_from(wanted: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` that the old store can supply."""
    return wanted.join(old.select(*keys).distinct(), list(keys), "left_semi")


def copy_from_old(old: DataFrame, new: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """Old rows to carry over: asked for (if ``wanted`` is given) and not yet in the new store."""
    rows = reusable_from(old, wanted, keys) if wanted is not None else old
    return absent_from(rows, new, keys)


def overlay(newer: Column, older: Column) -> Column:
    """The newer value where there is one."""
    return F.coalesce(newer, older)
