"""Feed files to the star schema, as a batch and as a stream."""

import datetime as dt
from pathlib import Path
import os

import pytest
from conftest import FIXTURES, rows
from pyspark.sql import functions as F

from newsgraph.plans.crawl import crawl, picked_pages
from newsgraph.plans.load import load_records
from newsgraph.sinks.store import StarStore
from newsgraph.sources.feeds import feed_addresses, feed_items, newest_items, read_feeds, stream_feeds
from newsgraph.sources.tables import landed_pages, query_scan
from newsgraph.streaming.cycle import keep_running, pick_stream, run_cycles
from newsgraph.streaming.progress import watch

NOW = dt.datetime(2016, 12, 8, tzinfo=dt.timezone.utc)
FEEDS = str(FIXTURES / "feeds")


@pytest.fixture(scope="module")
def beats(spark):
    return spark.createDataFrame([(1, "Business"), (9, "World"), (20, "Chess")], "beat_id int, beat_topic string")


@pytest.fixture(scope="module")
def to_records(site_pages, beats, gazetteer):
    picked = picked_pages(site_pages)
    return lambda channels: crawl(feed_items(channels), picked, beats, gazetteer)


def star(store):
    return rows(
        store.read("article").join(store.read("journalist"), "journalist_id")
        .join(store.read("article_subbeat"), "article_id", "left")
        .join(store.read("sub_beat"), "sub_beat_id", "left"),
        "email", "name", "association", "article_title", "publication_date", "sub_beat_topic", "beat_id")


WANTED = [
    ("ann.lee@news.example.org", "Ann Lee", "Wire", "Q&A: \"money\" - Wire", dt.datetime(2016, 12, 6, 11, 30), None, None),
    ("jane@example.com", "Jane Doe", "The Daily", "Rates rise - again - The Daily", dt.datetime(2016, 12, 5, 10), "Housing & rent", 1),
    ("span@example.com", "Jane Doe", "Span story", "Span story", dt.datetime(2016, 12, 7, 9), None, None),
]


def test_feed_items(spark):
    items = feed_items(read_feeds(spark, FEEDS))
    got = rows(items, "beat_link", "pos", "link", "category", "guid_text")
    assert len(got) == 6 and items.select("item_id").distinct().count() == 6
    assert ("http://beats.example.com/business", 3, "http://news.example.com/missing", None, "cluster=abc") in got
    assert {r[0] for r in rows(items, "beat_link")} == {"http://beats.example.com/business", "http://beats.example.com/world"}


def test_batch(spark, tmp_path, to_records):
    store = StarStore(spark, str(tmp_path / "s"))
    load_records(store, to_records(read_feeds(spark, FEEDS)), now=NOW)
    assert star(store) == WANTED


def test_crawl_records(spark, to_records):
    got = {r["email"]: r for r in to_records(read_feeds(spark, FEEDS)).collect()}
    assert set(got) == {w[0] for w in WANTED}  # one record per contact, none without an address
    assert got["span@example.com"]["beat_id"] == 0 and got["ann.lee@news.example.org"]["beat_id"] == 1
    assert got["ann.lee@news.example.org"]["cid"] is None  # a guid without "=" hurts only its own row
    assert got["jane@example.com"]["pos"] == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_stream_equals_the_same_batches_in_order(spark, tmp_path, to_records, reverse):
    """Copies of a story over several batches: the first stays, as in batch loads of the same files."""
    landing = tmp_path / "landing"
    landing.mkdir()
    files = sorted(Path(FEEDS).glob("*.xml"), reverse=reverse)
    for i, file in enumerate(files):
        target = landing / file.name
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_000_000_000 + 60 * i,) * 2)
    store, batches = StarStore(spark, str(tmp_path / "s")), StarStore(spark, str(tmp_path / "b"))
    args = dict(checkpoint=str(tmp_path / "c"), to_records=to_records, once=True, now=NOW)
    log = watch(spark, str(tmp_path / "log"))
    run_cycles(stream_feeds(spark, str(landing), files_per_batch=1), store, **args).awaitTermination()
    for file in files:
        load_records(batches, to_records(read_feeds(spark, str(landing / file.name))), now=NOW)
    assert star(store) == star(batches)
    assert store.read("run_log").count() == len(files)
    before = store.manifest()
    run_cycles(stream_feeds(spark, str(landing), files_per_batch=1), store, **args).awaitTermination()
    assert store.manifest() == before  # nothing new landed
    spark.streams.removeListener(log)


def test_second_source_with_a_new_checkpoint_is_loaded(spark, tmp_path, to_records):
    store = StarStore(spark, str(tmp_path / "s"))
    run_cycles(stream_feeds(spark, FEEDS), store, str(tmp_path / "c1"),
               lambda channels: to_records(channels).limit(0), once=True, now=NOW).awaitTermination()
    run_cycles(stream_feeds(spark, FEEDS), store, str(tmp_path / "c2"), to_records, once=True, now=NOW).awaitTermination()
    assert star(store) == WANTED


def test_restart_after_failure(spark, tmp_path, to_records):
    store, calls = StarStore(spark, str(tmp_path / "s")), []

    def flaky(channels):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return to_records(channels)

    def start():
        return run_cycles(stream_feeds(spark, FEEDS), store, str(tmp_path / "c"), flaky, once=True, now=NOW)

    keep_running(start, pause=0, restarts=1)
    assert star(store) == WANTED and len(calls) == 2


def test_page_stream(spark, tmp_path, site_pages):
    site_pages.repartition(3).write.parquet(str(tmp_path / "landing"))
    landed = spark.readStream.schema(site_pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
    pick_stream(landed, str(tmp_path / "picked"), str(tmp_path / "c"), once=True).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "picked"))) == rows(picked_pages(site_pages))


def test_feed_addresses(beats):
    got = rows(feed_addresses(beats, "http://feeds.example.com/rss?num=50"), "beat_id", "feed_url")
    assert got == [(1, "http://feeds.example.com/rss?num=50&topic=b"), (9, "http://feeds.example.com/rss?num=50&topic=w")]


def test_newest_items(spark):
    df = spark.sql("select 'f' feed, id, timestamp'2020-01-10 00:00:00' - make_dt_interval(0, cast(id as int)) ts from range(100)")
    got = newest_items(df, F.lit(dt.datetime(2020, 1, 10)), "ts", "feed", "id", days=2, n=30)
    assert sorted(r["id"] for r in got.collect()) == list(range(30))
    assert newest_items(df, F.lit(dt.datetime(2020, 1, 10)), "ts", "feed", "id", days=1, n=50).count() == 25


def test_page_lookup_and_query_scan(spark, site_pages):
    links = spark.createDataFrame([("http://twitter.com/ann",), ("http://twitter.com/ann",), ("http://x",), (None,)], "link string")
    got = landed_pages(links, "link", site_pages)
    assert rows(got.select("url", F.col("html").isNotNull())) == [("http://twitter.com/ann", True), ("http://x", False)]
    assert query_scan(spark, "select count(*) n from {pages}", pages=site_pages).first()["n"] == site_pages.count()
