"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsgraph.staging import hadoop_fs, new_path

#: A side is only broadcast when its counted rows times their width stay below this.
BROADCAST_BYTES = 24 << 20
#: The white space of all word rules: blank, tab, line feed, VT, form feed, CR.
BLANKS = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Written:
    """A frame written to the shared folder; ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        fs, target = hadoop_fs(self.spark, self.path)
        fs.delete(target, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    return Written(df, name, **options).df


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows one, else as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def words_of(text: Column) -> Column:
    """The words of a text as an array; no word for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def running_sum(
    df: DataFrame, order: Sequence[str], value: str, out: str, group: str | None = None
) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before this one.

    ``order`` (and ``group``, whose rows come first by it) sort the rows; ties
    get an order of their own. Rows are range-partitioned and written, so no
    group or tie meets in one task; the sums of whole partitions (one row per
    partition and group in it) give the offsets. ``group`` must not be null.
    """
    first = [group] if group else []
    keys = [*first, *order, "_tie"]
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    rows = written(ranged, "ranged")
    before = Window.partitionBy(*first).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*first, "_part").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy("_part", *first).orderBy(*order, "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*first, "_part"])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_offset", "_part", "_tie")
    )
