"""Stored dimensions, pushed-down queries and landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def query_scan(spark: SparkSession, query: str, jdbc: dict[str, str] | None = None, **views: DataFrame) -> DataFrame:
    """Result of a query text.

    With ``jdbc`` the text runs in that database (option ``query``); otherwise
    it runs in Spark over the given frames, which its ``{name}`` fields name.
    """
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).option("query", query).load()
    return spark.sql(query, **views)


LANDED = "landed_at"


def newest_versions(pages: DataFrame, version: str = LANDED) -> DataFrame:
    """(url, version): the newest version of every address, from the two narrow columns."""
    return pages.groupBy("url").agg(F.max(version).alias(version))


def landed_pages(df: DataFrame, link: str, pages: DataFrame, how: str = "left", version: str = LANDED) -> DataFrame:
    """Join addresses to landed pages; every address is looked up once.

    Where pages have a ``version`` column only the newest version of an address
    counts. It is chosen on address and version alone, among the wanted
    addresses, before any page text is read; a page that landed twice at the
    same time comes back twice.

    The pages are cut down to the wanted addresses first: a left join keeps its
    left side whole, so it could not broadcast a handful of addresses and would
    shuffle every page text.
    """
    wanted = df.select(df[link].alias("url")).where("url is not null").distinct()
    found = pages.join(wanted, "url", "left_semi")
    if version in pages.columns:
        newest = newest_versions(pages.select("url", version).join(wanted, "url", "left_semi"), version)
        found = pages.join(newest.withColumnsRenamed({"url": "_url", version: "_version"}),
                           (F.col("url") == F.col("_url")) & F.col(version).eqNullSafe(F.col("_version")), "left_semi")
    return wanted.join(found, "url", how)
