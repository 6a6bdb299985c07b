"""Order numbers, surrogate ids and newest-first reads.

Dense numbers never go through one task: rows are sorted by range, every row
takes its position inside its partition, and the partition sizes (one row per
partition) give the offset to add.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.staging import stage

# monotonically_increasing_id() puts the partition above bit 33
_PARTITION_SHIFT = 33


def dense_numbers(
    df: DataFrame,
    order_by: Sequence[str],
    number: str,
    after: int | Column = 0,
) -> DataFrame:
    """Add ``number``: ``after + 1, after + 2, ...`` in the order of ``order_by``.

    Equal to a global ``row_number()`` when the order columns are unique per
    row. The sorted rows are written before they are counted, so that the
    counts and the numbers come from the same partitions even when a task is
    run again. The sort samples its input first, so pass a written frame.
    """
    start = after if isinstance(after, Column) else F.lit(after)
    slotted = stage(
        df.orderBy(*order_by).withColumn("_slot", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftright("_slot", _PARTITION_SHIFT)
    in_part = F.col("_slot") - F.shiftleft("_part", _PARTITION_SHIFT)
    sizes = slotted.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # one row per partition of the sort, so a single ordered window is safe
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        slotted.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(
            *df.columns,
            (F.col("_offset") + in_part + F.lit(1) + start).cast("bigint").alias(number),
        )
    )


def newest_ids(stored: DataFrame, id_column: str, n: int, *columns: str) -> DataFrame:
    """The ``n`` highest ids (a top-k, so no full sort)."""
    return stored.select(id_column, *columns).orderBy(F.desc(id_column)).limit(n)


def by_order(df: DataFrame, order_no: str = "order_no") -> DataFrame:
    return df.orderBy(F.asc(order_no))


def newest_per_group(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[Column],
    n: int,
    spread: Sequence[str],
    slices: int = 64,
    rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of every group with their rank, exact also for very
    large groups.

    A row among the first ``n`` of its group is also among the first ``n`` of
    its slice, so a big group is cut down in ``slices`` tasks before its
    survivors (at most ``slices * n``) meet in one. Spark cuts to ``n`` before
    the shuffle as well (``WindowGroupLimit``). ``spread`` names the columns
    that pick the slice.
    """
    slice_of = F.pmod(F.xxhash64(*spread), F.lit(slices))
    by_slice = Window.partitionBy(*group, "_slice").orderBy(*order_by)
    by_group = Window.partitionBy(*group).orderBy(*order_by)
    return (
        df.withColumn("_slice", slice_of)
        .withColumn(rank, F.row_number().over(by_slice))
        .where(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(by_group))
        .where(F.col(rank) <= n)
        .drop("_slice")
    )
