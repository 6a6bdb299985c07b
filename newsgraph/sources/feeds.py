"""Feeds: topic table to feed addresses, landed RSS to item rows, crawl records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsgraph.functions.dates import feed_timestamp
from newsgraph.functions.text import clean_html, cluster_id, publisher_of
from newsgraph.operators.numbering import newest_per_group
from newsgraph.schemas import FEED_CHANNEL

# Query suffix of the known topics.
TOPIC_SUFFIX = {
    "Business": "topic=b",
    "Entertainment": "topic=e",
    "Sports": "topic=s",
    "Technology": "topic=tc",
    "Science": "topic=snc",
    "Health": "topic=m",
    "Spotlight": "topic=ir",
    "Elections": "topic=el",
    "World": "topic=w",
    "Local": "geo=detect_metro_area",
}
#: what makes a feed item the same one when its feed lands again
ITEM_KEYS = ["beat_link", "title", "link", "category", "pub_date", "guid_text"]
FEED_ITEMS = 50
FEED_DAYS = 2


def feed_addresses(beats: DataFrame, base_url: str) -> DataFrame:
    """Beats with a known topic and the address of their feed.

    The map is a ten-entry literal, so the lookup is a projection.
    """
    suffixes = F.create_map(*(F.lit(x) for pair in TOPIC_SUFFIX.items() for x in pair))
    suffix = F.try_element_at(suffixes, F.col("beat_topic"))
    return beats.withColumn("feed_url", F.concat(F.lit(base_url + "&"), suffix)).where(
        F.col("feed_url").isNotNull()
    )


CHANNEL_END = "</channel>"
_CORRUPT = "_corrupt_record"


def _landed(reader) -> object:
    """A text reader that gives one record per channel of a file, of any size."""
    return reader.format("text").option("lineSep", CHANNEL_END)


def _parsed(records: DataFrame, keep_rejects: bool) -> DataFrame:
    """Channel rows of landed records; with ``keep_rejects`` also those that are
    none, with ``reject_reason`` and ``reject_text``.

    A record is the text up to the end of a channel. What follows the last
    channel of a file - closing tags, blanks, comments - is no record.
    """
    text = F.col("value")
    channel = F.regexp_extract(text, r"(?s)<channel(?=[\s>]).*", 0)
    schema = StructType([*FEED_CHANNEL, StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    tail = text.rlike(r"^(?s)\s*(?:(?:</[\w:.-]+\s*>|<!--(?:(?!-->).)*-->)\s*)*$")
    rows = records.select(
        F.col("_metadata.file_path").alias("feed"), text.alias("landed"), channel.alias("channel"), tail.alias("tail"),
    ).where((F.col("channel") != "") | ~F.col("tail")).withColumn(
        "c", F.when(F.col("channel") != "", F.from_xml(F.concat("channel", F.lit(CHANNEL_END)), schema.simpleString(), options)))
    reason = F.when(F.col("channel") == "", F.lit("no channel")).when(
        F.col("c").isNull() | F.col(f"c.{_CORRUPT}").isNotNull(), F.lit("malformed channel"))
    rows = rows.withColumn("reject_reason", reason)
    columns = [F.when(F.col("reject_reason").isNull(), F.col(f"c.{f.name}")).alias(f.name) for f in FEED_CHANNEL]
    if keep_rejects:
        landed = F.when(F.col("reject_reason").isNotNull(), F.col("landed")).alias("reject_text")
        return rows.select(*columns, "feed", "reject_reason", landed)
    return rows.where("reject_reason is null").select(*columns, "feed")


def read_feeds(spark: SparkSession, *paths: str, keep_rejects: bool = False) -> DataFrame:
    """One row per landed channel; ``keep_rejects`` keeps what is no channel too
    (see ``split_rejects``). An empty file has neither."""
    return _parsed(_landed(spark.read).load(list(paths)), keep_rejects)


def stream_feeds(spark: SparkSession, path: str, files_per_batch: int = 1000, keep_rejects: bool = False) -> DataFrame:
    """The same table as a stream of newly landed feed files."""
    landed = _landed(spark.readStream).option("maxFilesPerTrigger", files_per_batch)
    return _parsed(landed.load(path), keep_rejects)


def split_rejects(feeds: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(channels, rejects as (feed, reason, landed)) of feeds read with ``keep_rejects``."""
    if "reject_reason" not in feeds.columns:
        return feeds, None
    bad = F.col("reject_reason").isNotNull()
    return feeds.where(~bad).drop("reject_reason", "reject_text"), feeds.where(bad).select(
        "feed", F.col("reject_reason").alias("reason"), F.col("reject_text").alias("landed"))


def parse_feeds(df: DataFrame, xml: str, feed: str) -> DataFrame:
    """Feeds that were landed as a text column with the whole RSS document."""
    document = F.from_xml(F.col(xml), f"channel {FEED_CHANNEL.simpleString()}")
    return df.select(F.col(feed).alias("feed"), document["channel"].alias("c")).select("c.*", "feed")


def feed_items(channels: DataFrame) -> DataFrame:
    """One row per item with its position, guid text and the link of its feed.
    Rows that are no channel (``keep_rejects``) stay as they are, without item."""
    rejects = [c for c in ("reject_reason", "reject_text") if c in channels.columns]
    explode = F.posexplode_outer if rejects else F.posexplode
    items = channels.select("feed", F.col("link").alias("beat_link"), explode("item").alias("pos", "item"), *rejects)
    if rejects:
        items = items.where("item is not null or reject_reason is not null")
    return items.select(
        F.concat_ws("#", "feed", "pos").alias("item_id"),
        "feed",
        "pos",
        "beat_link",
        "item.title",
        "item.link",
        "item.category",
        F.col("item.pubDate").alias("pub_date"),
        F.col("item.guid._VALUE").alias("guid_text"),
        *rejects,
    )


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    first, *rest = feeds
    for feed in rest:
        first = first.unionByName(feed)
    return first


def newest_items(
    items: DataFrame, as_of: Column, ts: str, feed: str, item: str,
    days: int = FEED_DAYS, n: int = FEED_ITEMS,
) -> DataFrame:
    """The newest ``n`` items of every feed within the last ``days`` days."""
    recent = items.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))
    return newest_per_group(recent, [feed], [F.desc(ts), F.asc(item)], n, [item])


def crawl_records(items: DataFrame, contacts: DataFrame) -> DataFrame:
    """Items with contacts in the fixed record layout, plus the story columns.

    The journalist id starts as 0 and the article id as null; both are given
    by the load.
    """
    return items.join(contacts, "item_id").select(
        F.lit(0).alias("journalist_id"),
        "name",
        F.lit(None).cast("string").alias("designation"),
        F.col("category").alias("beat"),
        F.lit(None).cast("string").alias("tags"),
        "state",
        "country",
        "email",
        "media_link",
        "linkedin_url",
        "website",
        publisher_of(F.col("title")).alias("association"),
        "about_info",
        F.lit(None).cast("int").alias("article_id"),
        feed_timestamp(F.col("pub_date")).alias("publication_date"),
        clean_html(F.col("title")).alias("article_title"),
        F.col("link").alias("article_link"),
        "feed",
        "pos",
        "beat_link",
        "guid_text",
        cluster_id(F.col("guid_text")).alias("cid"),
    )
