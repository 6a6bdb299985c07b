"""Scans, sources and topic-to-feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.catalog import views as v
from newsgraph.catalog.registry import query
from newsgraph.functions.text import escape_xml
from newsgraph.operators.topics import last_listed
from newsgraph.operators.lookups import beat_ids
from newsgraph.sources.feeds import (
    TOPIC_SUFFIX,
    feed_addresses,
    feed_items,
    newest_items,
    parse_feeds,
    read_feeds,
    union_feeds,
)
from newsgraph.sources.tables import landed_pages, query_scan
from newsgraph.staging import new_path


def _channels(spark, sf):
    """Every page as one feed channel: its navigation links are the items."""
    links = F.regexp_extract_all("html", F.lit(v.NAV_LINK), F.lit(1))
    page = F.col("page_id").cast("string")
    item = lambda text, i: F.struct(
        F.concat(text, F.lit(" - "), page).alias("title"),
        F.concat_ws("/", F.lit("http://news.example.com"), page, i.cast("string")).alias("link"),
        F.regexp_extract("url", v.URL_PARTS, 2).alias("category"),
        F.lit("Mon, 05 Dec 2016 10:00:00 GMT").alias("pubDate"),
        F.struct(
            F.concat(F.lit("cluster="), page).alias("_VALUE"), F.lit("false").alias("_isPermaLink")
        ).alias("guid"),
    )
    return v.table(spark, sf, "pages").select(
        page.alias("title"), F.col("url").alias("link"), F.transform(links, item).alias("item")
    )


def _rss(spark, sf):
    """The same channels as RSS documents in a text column."""

    def element(tag, value, attributes=""):
        return F.concat(F.lit(f"<{tag}{attributes}>"), escape_xml(value), F.lit(f"</{tag}>"))

    def item(i):
        texts = [element(tag, i[tag]) for tag in ("title", "link", "category", "pubDate")]
        guid = element("guid", i["guid"]["_VALUE"], ' isPermaLink="false"')
        return F.concat(F.lit("<item>"), *texts, guid, F.lit("</item>"))

    return _channels(spark, sf).select(
        F.col("link").alias("feed"),
        F.concat(
            F.lit("<rss><channel>"), element("title", F.col("title")), element("link", F.col("link")),
            F.array_join(F.transform("item", item), ""), F.lit("</channel></rss>"),
        ).alias("xml"),
    )


_RSS_SQL = f"""WITH {v.PAGE_ITEMS}, {v.NAV_TOPICS}
SELECT p.link AS beat_link, n.pos, n.topic || ' - ' || p.item_id AS title,
       'http://news.example.com/' || p.item_id || '/' || CAST(n.pos AS VARCHAR) AS link,
       p.category, 'Mon, 05 Dec 2016 10:00:00 GMT' AS pub_date,
       'cluster=' || p.item_id AS guid_text
FROM page_items p JOIN nav_topics n ON n.page_id = p.pos"""
_RSS_COLUMNS = ["beat_link", "pos", "title", "link", "category", "pub_date", "guid_text"]


@query("src_1_feed_scan", _RSS_SQL)
def feed_scan(spark, sf):
    path = new_path(spark, "feeds")
    channels = _channels(spark, sf)
    channels.write.format("xml").option("rootTag", "rss").option("rowTag", "channel").save(path)
    return feed_items(read_feeds(spark, path)).select(*_RSS_COLUMNS)


@query("src_2_feed_items", _RSS_SQL)
def feed_column(spark, sf):
    return feed_items(parse_feeds(_rss(spark, sf), "xml", "feed")).select(*_RSS_COLUMNS)


@query(
    "src_3_dimension_scan",
    "SELECT n_nationkey AS beat_id, n_name AS beat_topic FROM nation",
)
def dimension_scan(spark, sf):
    return v.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("beat_id"), F.col("n_name").alias("beat_topic")
    )


@query(
    "src_4_query_scan",
    "SELECT o_custkey AS journalist_id, count(*) AS articles FROM orders "
    "WHERE o_orderstatus = 'O' GROUP BY o_custkey",
)
def pushed_query(spark, sf):
    return query_scan(
        spark,
        "SELECT o_custkey AS journalist_id, count(*) AS articles FROM {orders} "
        "WHERE o_orderstatus = 'O' GROUP BY o_custkey",
        orders=v.table(spark, sf, "orders"),
    )


@query(
    "src_5_page_lookup",
    """WITH wanted AS (
  SELECT url FROM pages UNION SELECT replace(url, 'https://', 'http://') FROM pages)
SELECT w.url, p.page_id, length(p.html) AS n_chars
FROM wanted w LEFT JOIN pages p ON p.url = w.url""",
)
def page_lookup(spark, sf):
    pages = v.table(spark, sf, "pages")
    plain = F.replace("url", F.lit("https://"), F.lit("http://"))
    links = pages.select(F.explode(F.array("url", plain)).alias("link"))
    return landed_pages(links, "link", pages).select(
        "url", "page_id", F.length("html").cast("bigint").alias("n_chars")
    )


@query(
    "src_5_page_versions",
    """WITH wanted AS (
  SELECT url FROM pages UNION SELECT replace(url, 'https://', 'http://') FROM pages),
newest AS (SELECT url, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM pages GROUP BY url)
SELECT w.url, n.page_id, length(n.html) + 4 AS n_chars FROM wanted w LEFT JOIN newest n ON n.url = w.url""",
)
def page_versions(spark, sf):
    """Every page in two versions, and addresses that landed several times: the newest counts."""
    pages = v.table(spark, sf, "pages")
    plain = F.replace("url", F.lit("https://"), F.lit("http://"))
    links = pages.select(F.explode(F.array("url", plain)).alias("link"))
    at = lambda day: F.expr(f"timestamp'2024-01-{day} 00:00:00' + make_dt_interval(0, 0, 0, page_id)")
    first = pages.select("page_id", "url", "html", at("01").alias("landed_at"))
    second = pages.select("page_id", "url", F.concat("html", F.lit("<br>")).alias("html"), at("31").alias("landed_at"))
    return landed_pages(links, "link", second.unionByName(first)).select(
        "url", "page_id", F.length("html").cast("bigint").alias("n_chars")
    )


@query(
    "src_6_newest_per_feed",
    """SELECT event_type AS feed, event_id, rn FROM (
  SELECT event_type, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn
  FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY)
WHERE rn <= 50""",
)
def newest_per_feed(spark, sf):
    events = v.table(spark, sf, "events")
    as_of = v.latest(events, "ts")
    newest = newest_items(
        events.select("ts", "event_id", F.col("event_type").alias("feed")), as_of, "ts", "feed", "event_id"
    )
    return newest.select("feed", "event_id", F.col("rank").cast("bigint").alias("rn"))


_TOPIC_LIST = [*TOPIC_SUFFIX, "Weather", "Chess"]
_TOPIC_SQL = ", ".join(f"'{t}'" for t in _TOPIC_LIST)
_CASES = " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in TOPIC_SUFFIX.items())


@query(
    "prj_1_topic_feed",
    f"""WITH b AS (SELECT p_partkey AS beat_id, [{_TOPIC_SQL}][p_partkey % 12 + 1] AS beat_topic
  FROM part)
SELECT beat_id, beat_topic, 'http://feeds.example.com/rss?num=50&' || suffix AS feed_url
FROM (SELECT *, CASE beat_topic {_CASES} END AS suffix FROM b) WHERE suffix IS NOT NULL""",
)
def topic_feed(spark, sf):
    names = F.array(*(F.lit(t) for t in _TOPIC_LIST))
    beats = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("beat_id"),
        F.element_at(names, (F.col("p_partkey") % 12 + 1).cast("int")).alias("beat_topic"),
    )
    return feed_addresses(beats, "http://feeds.example.com/rss?num=50")


@query(
    "set_2_feed_union",
    "SELECT 'a' || CAST(page_id AS VARCHAR) AS item_id FROM pages UNION ALL "
    "SELECT 'b' || CAST(doc_id AS VARCHAR) FROM documents UNION ALL "
    "SELECT 'c' || CAST(event_id AS VARCHAR) FROM events",
)
def feed_union(spark, sf):
    def feed(name, key, mark):
        key = F.concat(F.lit(mark), F.col(key).cast("string"))
        return v.table(spark, sf, name).select(key.alias("item_id"))

    return union_feeds(
        [feed("pages", "page_id", "a"), feed("documents", "doc_id", "b"), feed("events", "event_id", "c")]
    )


FLAGSHIP_SQL = f"""WITH {v.PAGE_ITEMS}, {v.NAV_TOPICS},
langs AS (SELECT lang AS beat_topic, CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS beat_id
  FROM (SELECT DISTINCT CASE WHEN lang = 'es' THEN 'other' ELSE lang END AS lang FROM documents)),
last_nav AS (SELECT page_id, arg_max(topic, pos) AS topic FROM nav_topics GROUP BY page_id)
SELECT coalesce(b.beat_id, 0) AS beat_id, t.topic, count(*) AS pages
FROM page_items i LEFT JOIN langs b ON b.beat_topic = i.category
LEFT JOIN last_nav t ON t.page_id = i.pos
GROUP BY 1, 2"""


def language_beats(spark, sf):
    """Document languages, numbered by name; Spanish under another name, so that its pages find no beat."""
    name = F.when(F.col("lang") == "es", F.lit("other")).otherwise(F.col("lang"))
    langs = v.table(spark, sf, "documents").select(name.alias("beat_topic")).distinct()
    return v.dense_numbers(langs, ["beat_topic"], "beat_id").withColumn(
        "beat_id", F.col("beat_id").cast("int")
    )


@query("beat_topic_counts", FLAGSHIP_SQL)
def beat_topic_counts(spark, sf):
    """Flagship: landed pages to items, beat by category (0 when unknown), last
    navigation topic, pages per beat and topic.

    The topics stay in the row of their page, so the pages are scanned once
    and only the counts are shuffled.
    """
    items = v.table(spark, sf, "pages").select(
        F.regexp_extract("url", v.URL_PARTS, 2).alias("category"),
        last_listed(F.regexp_extract_all("html", F.lit(v.NAV_LINK), F.lit(1))).alias("topic"),
    )
    return (
        beat_ids(items, language_beats(spark, sf), "category")
        .groupBy("beat_id", "topic")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
