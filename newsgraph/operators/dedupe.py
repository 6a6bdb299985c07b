"""First-row and distinct operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(
    df: DataFrame, keys: Sequence[str | Column], order_by: Sequence[str | Column]
) -> DataFrame:
    """One row per key, the first in ``order_by``.

    The rank test lets Spark keep one row per key and task before the shuffle
    (``WindowGroupLimit``), so a hot key sends one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order_by)
    return (
        df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")
    )


def first_per_email(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """First record of every e-mail address, compared without case."""
    return first_per_key(df, [F.lower(F.trim("email"))], order_by)


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def one_row_per_topic(df: DataFrame) -> DataFrame:
    """Distinct topics with the lowest beat id each was seen under."""
    return df.groupBy("sub_beat_topic").agg(F.min("beat_id").alias("beat_id"))
