"""Page versions, feed rejects, and lookups of picked elements by address."""

import datetime as dt

import pytest
from conftest import FIXTURES, rows
from pyspark.sql import functions as F

from newsgraph.operators.contacts import contact_entries, newest_picks, pages_of
from newsgraph.operators.elements import PICKED
from newsgraph.operators.entity import first_word_index, naming
from newsgraph.operators.topics import story_topics
from newsgraph.plans.crawl import crawl, pick_pages, picked_pages
from newsgraph.plans.load import load_records
from newsgraph.sinks.store import StarStore
from newsgraph.sources.feeds import feed_items, read_feeds, split_rejects, stream_feeds
from newsgraph.sources.picked import PickedPages
from newsgraph.sources.tables import landed_pages
from newsgraph.streaming.cycle import run_cycles, store_picks

NOW = dt.datetime(2016, 12, 8, tzinfo=dt.timezone.utc)
GOOD = "<channel><title>t</title><link>http://b</link><item><title>a</title><link>http://x</link></item></channel>"
BROKEN = {
    "cut.xml": "<rss><channel><title>t</title><item><title>a",
    "text.xml": "this is no feed <at all",
    "mixed.xml": f"<?xml version='1.0'?><rss>{GOOD}<channel><title>no end</channel>{GOOD}</rss>\n",
    "empty.xml": "",
    "none.xml": "<rss><other/></rss>",
    "tail.xml": f"<rss>{GOOD}\n</rss> <!-- done -->\n",
}


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name, text in BROKEN.items():
        (folder / name).write_text(text)
    return str(folder)


def by_name(frame, *columns):
    return sorted((r[0].rpartition("/")[2], *r[1:]) for r in frame.select("feed", *columns).collect())


WANTED_REJECTS = [("cut.xml", "malformed channel"), ("mixed.xml", "malformed channel"), ("none.xml", "no channel"),
                  ("text.xml", "no channel")]


def test_rejects_of_a_batch(spark, landing):
    channels, rejects = split_rejects(read_feeds(spark, landing, keep_rejects=True))
    assert by_name(rejects, "reason") == WANTED_REJECTS
    assert {r["landed"] for r in rejects.collect()} >= {BROKEN["text.xml"], BROKEN["cut.xml"]}
    assert by_name(channels, "title") == [("mixed.xml", "t")] * 2 + [("tail.xml", "t")]
    assert rows(channels.drop("feed")) == rows(read_feeds(spark, landing).drop("feed"))


def test_rejects_are_stored_and_counted(spark, landing, tmp_path, site_pages, gazetteer):
    beats = spark.createDataFrame([(1, "Business")], "beat_id int, beat_topic string")
    picked = picked_pages(site_pages)
    to_records = lambda items: crawl(items, picked, beats, gazetteer)
    for file in (FIXTURES / "feeds").glob("*.xml"):
        (tmp_path / "landing" / file.name).write_bytes(file.read_bytes())
    batch, stream = StarStore(spark, str(tmp_path / "b")), StarStore(spark, str(tmp_path / "s"))
    channels, rejects = split_rejects(read_feeds(spark, landing, keep_rejects=True))
    load_records(batch, to_records(feed_items(channels)), rejects=rejects, now=NOW)
    run_cycles(feed_items(stream_feeds(spark, landing, keep_rejects=True)), stream, str(tmp_path / "c"), to_records,
               keys=["beat_link", "title", "link"], once=True, now=NOW).awaitTermination()
    for store in (batch, stream):
        assert by_name(store.read("feed_reject"), "reason") == [("broken.xml", "no channel"), *WANTED_REJECTS]
        assert rows(store.read("run_log"), "rejects") == [(5,)]
    assert rows(batch.read("journalist"), "email") == rows(stream.read("journalist"), "email") != []


def versions(site_pages):
    """The pages, and older and newer versions without their elements or with others."""
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    older = site_pages.withColumn("html", F.concat(F.lit("<a rel=author href=http://old>Old Name</a>"), "html"))
    return site_pages.withColumn("landed_at", at(5)).unionByName(older.withColumn("landed_at", at(1))).unionByName(
        older.where(F.rand() < -1).withColumn("landed_at", at(9)))


def test_newest_version_counts(spark, site_pages, gazetteer):
    links = site_pages.select(F.col("url").alias("link"))
    found = landed_pages(links, "link", versions(site_pages))
    assert rows(found, "url", "html") == rows(site_pages, "url", "html")
    items = links.select(F.col("link").alias("item_id"), "link")
    wanted = contact_entries(items, picked_pages(site_pages), gazetteer)
    assert rows(contact_entries(items, picked_pages(versions(site_pages)), gazetteer)) == rows(wanted)


def test_a_version_without_elements_hides_older_ones(spark, site_pages):
    gone = site_pages.select("url", F.lit("<p>gone</p>").alias("html"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("landed_at"))
    picked = picked_pages(versions(site_pages).unionByName(gone))
    assert newest_picks(picked).count() == 0
    assert picked.where(F.size("picks") == 0).count() >= site_pages.count()


def test_stored_picks_equal_the_table(spark, tmp_path, site_pages, gazetteer):
    every = versions(site_pages)
    path = str(tmp_path / "landing")
    every.repartition(3).write.parquet(path)
    table = PickedPages(spark, str(tmp_path / "picked"), range_rows=4)
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for _ in range(2):  # started again with its checkpoint it adds nothing
        store_picks(stream, table, str(tmp_path / "c"), once=True).awaitTermination()
    assert rows(table.read()) == rows(pick_pages(every).select("url", "landed_at", "picks"))
    links = site_pages.select("url").limit(1)
    assert rows(pages_of(table, links)) == rows(pages_of(picked_pages(every), links))
    assert len(table.lookup(links).inputFiles()) < len(table.read().inputFiles())
    items = site_pages.select(F.col("url").alias("item_id"), F.col("url").alias("link"))
    assert rows(contact_entries(items, table, gazetteer)) == rows(contact_entries(items, picked_pages(site_pages), gazetteer))


def test_many_stories_on_a_page(spark):
    """10,000 blocks, each cluster id twice: the first block of an id counts."""
    n = 10_000
    element = lambda pick, pos, scope, cid, text: (pick, pos, scope, 0, None, cid, text)
    picks = []
    for i in range(n):
        at = 3 * i
        picks += [element("story", at, None, str(i % (n // 2)), ""), element("topics", at + 1, at, None, ""),
                  element("topic", at + 2, at + 1, None, f"topic {i}")]
    assert [f.name for f in PICKED.elementType] == ["pick", "pos", "scope", "nth", "href", "cid", "text"]
    page = spark.createDataFrame([("u", picks)], f"url string, picks {PICKED.simpleString()}")
    got = {(r.cid, r.topic) for r in story_topics(page).collect()}
    assert got == {(str(i), f"topic {i}") for i in range(n // 2)}


def test_first_word_index_passes_every_name(spark):
    names = [("Ann Lee",), ("Acme",), ("New York City",), ("Ärger",)] + [(f"w{i} x",) for i in range(500)]
    gazetteer = spark.createDataFrame(names, "entity string")
    may_begin = first_word_index(gazetteer)
    words = spark.createDataFrame([("Ann",), ("Acme",), ("New",), ("w499",)], "w string")
    assert words.where(may_begin(F.col("w"))).count() == 4
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("w"))
    assert others.where(may_begin(F.col("w"))).count() < 2000
    texts = spark.createDataFrame([(1, "in New York City now"), (2, "New York"), (3, "Ann  Lee"), (4, "Ann"), (5, None), (6, "")], "id int, t string")
    assert rows(naming(texts, "id", "t", gazetteer)) == [(1,), (3,)]
    none = spark.createDataFrame([], "entity string")
    assert rows(naming(texts, "id", "t", none)) == []
