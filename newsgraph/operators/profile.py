"""Contact profiles as rows ``(item_id, pos, tag, value)``.

A profile never becomes one collected list: every step is an aggregation with
map-side combine, so the entries of a very large item stay spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.functions.text import clean_html, country_of, state_of

# Profile tags.
TAGS = ["email", "name", "Loc", "Media link", "LinkedIn", "website", "bio"]


def eligible(entries: DataFrame) -> DataFrame:
    """Entries of the items whose *first* e-mail entry is not empty."""
    first = (
        entries.where(F.col("tag") == "email")
        .groupBy("item_id")
        .agg(F.min_by("value", "pos").alias("_email"))
        .where(F.col("_email") != "")
    )
    return entries.join(first, "item_id", "left_semi")


def distinct_profile(entries: DataFrame) -> DataFrame:
    """First e-mail entry in front (``pos`` -1), all other entries once, by
    first appearance."""
    is_email = F.col("tag") == "email"
    return (
        entries.withColumn("_same", F.when(is_email, F.lit("")).otherwise(F.col("value")))
        .groupBy("item_id", "tag", "_same")
        .agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value"))
        .select(
            "item_id",
            F.when(is_email, F.lit(-1)).otherwise(F.col("pos")).cast("bigint").alias("pos"),
            "tag",
            "value",
        )
    )


def pivot_profile(entries: DataFrame) -> DataFrame:
    """One row per item, one column per tag; the last entry of a tag wins."""
    wide = entries.groupBy("item_id").pivot("tag", TAGS).agg(F.max_by("value", "pos"))
    return wide.select(
        "item_id",
        F.col("email"),
        F.col("name"),
        state_of(F.col("Loc")).alias("state"),
        country_of(F.col("Loc")).alias("country"),
        F.col("Media link").alias("media_link"),
        F.col("LinkedIn").alias("linkedin_url"),
        F.col("website"),
        clean_html(F.col("bio")).alias("about_info"),
    )


def contact_rows(entries: DataFrame) -> DataFrame:
    """Eligible profiles as one row each.

    After ``distinct_profile`` the only e-mail entry is the first one, so the
    eligibility test is a filter on the pivoted row and needs no join.
    """
    return pivot_profile(distinct_profile(entries)).where(F.col("email") != "")


def append_entries(*parts: DataFrame) -> DataFrame:
    """Entry lists of several sources as one; positions order the sources."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def entries_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (item, tag, value) of ``left`` that ``right`` does not have."""
    columns = ["item_id", "tag", "value"]
    return (
        left.select(*columns)
        .join(right.select(*columns).distinct(), columns, "left_anti")
        .distinct()
    )
