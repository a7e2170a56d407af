"""Order-based operators: top-k per group, exact ranks inside groups of any size, bounded lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfspark.session import materialize


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                  rank_col: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group under a total ``order``.

    The literal bound on ``row_number`` lets Spark plan ``WindowGroupLimit``: every map task
    keeps ``k`` rows per group before the shuffle, so a group of any size stays small.
    """
    rank = rank_col or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return out if rank_col else out.drop(rank)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int | None = None, slice_col: str = "_slice") -> DataFrame:
    """A written table of ``df`` in which consecutive rows by keys and ``order`` lie in consecutive, numbered slices.

    A large group lies in several slices. Rows that are equal in all of it go on in the next slice too, so no group and no repeated
    row decides how large a slice is. ``df`` is evaluated twice, once for the bounds of the slices: store it first if it is dear.
    """
    spread = df.withColumn("_spread", F.monotonically_increasing_id())
    placement = [*[F.col(c).asc() for c in keys], *order, F.col("_spread").asc()]
    placed = spread.repartitionByRange(slices, *placement) if slices else spread.repartitionByRange(*placement)
    return materialize(placed.withColumn(slice_col, F.spark_partition_id()), "sliced")


def counts_before(held: DataFrame, keys: Sequence[str], slice_col: str = "_slice") -> DataFrame:
    """(slice, keys, ``_n``, ``_before``): rows a group has in a slice and in all slices before. ``held`` is :func:`sliced`.

    The window sees one row per group and slice, never the rows themselves.
    """
    in_order = Window.partitionBy(*keys).orderBy(slice_col)
    counted = held.groupBy(slice_col, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.withColumn("_before", F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank_col: str = "rank",
                  descending: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """Exact 1-based row number inside each group (of all rows without ``keys``), for groups of any size; ties are in any order.

    No task gets a whole group, and no group is counted beforehand: rows are ranked inside (slice, group), and each group that
    continues from earlier slices gets the number of rows it had there. At most one group per slice continues, so the offsets
    have fewer rows than there are slices; that bound is what allows their broadcast.
    """
    by = [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]
    placed = sliced(df, keys, by, slices)
    offsets = counts_before(placed, keys).filter("_before > 0").drop("_n")
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*by, "_spread")))
    on = [F.col("l._slice") == F.col("o._slice")]
    on += [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return (local.alias("l").join(F.broadcast(offsets).alias("o"), on, "left")
            .select(*[F.col(f"l.{c}") for c in df.columns],
                    (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(rank_col)))


def batch_numbers(df: DataFrame, order: Sequence[str], size: int, batch_col: str = "batch") -> DataFrame:
    """0-based number of the batch of ``size`` rows each row falls in."""
    ranked = rank_in_group(df, [], order, "_rank")
    return ranked.withColumn(batch_col, F.floor((F.col("_rank") - 1) / size).cast("bigint")).drop("_rank")


def paged_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, page_size: int,
                list_col: str = "items", page_col: str = "page") -> DataFrame:
    """Ordered lists of ``value`` per group, cut into pages of ``page_size`` so that no row grows with its group."""
    narrow = df.select(*dict.fromkeys([*keys, *order]), value.alias("_value"))
    paged = rank_in_group(narrow, keys, order, "_rank").select(
        *keys, F.ceil(F.col("_rank") / page_size).cast("bigint").alias(page_col), "_rank", "_value")
    lists = paged.groupBy(*keys, page_col).agg(F.sort_array(F.collect_list(F.struct("_rank", "_value"))).alias("_l"))
    return lists.select(*keys, page_col, F.transform("_l", lambda e: e["_value"]).alias(list_col))
