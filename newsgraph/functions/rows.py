"""Whole-table projections and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from newsgraph.functions.text import trim_ws

# Columns a crawl record loses on its way to a target table.
NOT_JOURNALIST = ["beat", "publication_date", "article_title", "article_id", "article_link"]
NOT_SUB_BEAT = [
    "journalist_id", "article_id", "news_id", "guid_text", "channel_id", "beat_link", "cid",
]


def trim_all(df: DataFrame, unicode: bool = False) -> DataFrame:
    """Trim every string column in one projection; nulls stay null."""
    return df.select(
        *(
            trim_ws(F.col(field.name), unicode).alias(field.name)
            if isinstance(field.dataType, StringType)
            else F.col(field.name)
            for field in df.schema
        )
    )


def journalist_part(crawl: DataFrame) -> DataFrame:
    return crawl.drop(*NOT_JOURNALIST)


def sub_beat_part(work: DataFrame) -> DataFrame:
    return work.drop(*NOT_SUB_BEAT)


def article_part(crawl: DataFrame) -> DataFrame:
    return crawl.select(
        "article_id", "publication_date", "article_title", "article_link", "journalist_id"
    )


def bridge_part(work: DataFrame) -> DataFrame:
    """Bridge columns with an empty id in front, to be given by the target."""
    return work.select(
        F.lit(None).cast("int").alias("article_subbeats_id"), "article_id", "sub_beat_id"
    )


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither null nor empty."""
    return df.where(F.col(column) != "")


def without_empty(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose text is ``''``; rows with a null stay."""
    return df.where(F.col(column).isNull() | (F.col(column) != ""))


def split_on(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the flag holds, all other rows)."""
    holds = F.coalesce(flag, F.lit(False))
    return df.where(holds), df.where(~holds)


def reorder(df: DataFrame, first: Sequence[str], removed: Sequence[str]) -> DataFrame:
    """Put ``first`` in front, drop ``removed``, keep the rest; names ignore case."""
    by_name = {name.lower(): name for name in df.columns}
    front = [by_name[name.lower()] for name in first]
    gone = {name.lower() for name in [*first, *removed]}
    return df.select(*front, *(name for name in df.columns if name.lower() not in gone))
