"""Key lookups between a batch and the stored tables, all as equi-joins.

No side carries a broadcast hint: sizes come from the files or from finished
shuffle stages, so Spark broadcasts a side only when it is below its limit and
otherwise sort-merges, splitting partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def first_match(
    left: DataFrame, right: DataFrame, on: str, value: str, order_by: Sequence[str]
) -> DataFrame:
    """Left lookup of ``value``: the first match by ``order_by``, or null."""
    firsts = right.groupBy(on).agg(F.min_by(value, F.struct(*order_by)).alias(value))
    return left.join(firsts, on, "left")


def beat_ids(df: DataFrame, beats: DataFrame, topic: str = "beat") -> DataFrame:
    """Add ``beat_id`` by trimmed topic name, 0 when there is no such beat."""
    known = beats.groupBy(F.col("beat_topic").alias("_beat")).agg(
        F.min("beat_id").alias("beat_id")
    )
    return (
        df.withColumn("_beat", F.trim(topic))
        .join(known, "_beat", "left")
        .withColumn("beat_id", F.coalesce("beat_id", F.lit(0)))
        .drop("_beat")
    )


def stored_ids(batch: DataFrame, stored: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """(keys, lowest stored id) of those batch keys that are stored.

    The stored table is cut down by a semi join first. For a small batch that
    is one scan of the stored keys without a shuffle; the result is never
    larger than the batch.
    """
    wanted = batch.select(*keys).distinct()
    return (
        stored.select(*keys, id_column)
        .join(wanted, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.min(id_column).alias(id_column))
    )


def with_existence(
    batch: DataFrame, stored: DataFrame, keys: Sequence[str], id_column: str
) -> DataFrame:
    """Add ``is_exist`` and the stored id, 0 when the key is not stored."""
    known = stored_ids(batch, stored, keys, id_column)
    return (
        batch.join(known, list(keys), "left")
        .withColumn("is_exist", F.col(id_column).isNotNull())
        .withColumn(id_column, F.coalesce(id_column, F.lit(0).cast("bigint")))
    )


def already_stored(batch: DataFrame, stored: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Batch rows whose key is stored, with the stored id."""
    return batch.join(stored_ids(batch, stored, keys, id_column), list(keys))


def not_stored(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored.

    Only the stored keys of the batch reach the anti join, so its right side
    is bounded by the batch and not by the stored table.
    """
    wanted = batch.select(*keys).distinct()
    known = stored.select(*keys).join(wanted, list(keys), "left_semi").distinct()
    return batch.join(known, list(keys), "left_anti")


def restore_order(new_ids: DataFrame, batch: DataFrame, key: str = "email") -> DataFrame:
    """Give rows read back by key their order number in the batch, else 0."""
    order = batch.groupBy(key).agg(F.min("order_no").alias("order_no"))
    return new_ids.join(order, key, "left").withColumn(
        "order_no", F.coalesce("order_no", F.lit(0).cast("bigint"))
    )


def zip_on_order(left: DataFrame, right: DataFrame, order_no: str = "order_no") -> DataFrame:
    """Put two tables side by side by an explicit order number."""
    return left.join(right, order_no)


def default_member_id(sub_beats: DataFrame, topic: str = "Other") -> DataFrame:
    """One row with the id of the default topic, 0 when it is not stored."""
    return sub_beats.where(F.col("sub_beat_topic") == topic).agg(
        F.coalesce(F.min("sub_beat_id"), F.lit(0).cast("bigint")).alias("default_id")
    )


def topic_ids(work: DataFrame, topics: DataFrame, default_id: DataFrame) -> DataFrame:
    """Add ``sub_beat_id``: by topic; the default id (a one-row frame, read as
    a scalar subquery) for an empty topic; null for a topic that was not found."""
    empty = F.coalesce("sub_beat_topic", F.lit("")) == ""
    known = topics.select("sub_beat_topic", "sub_beat_id")
    return work.join(known, "sub_beat_topic", "left").withColumn(
        "sub_beat_id", F.when(empty, default_id.scalar()).otherwise(F.col("sub_beat_id"))
    )


def merge_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Append by column name; a column that one side lacks is null there."""
    return left.unionByName(right, allowMissingColumns=True)
