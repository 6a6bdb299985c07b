"""Keyed state of the stream in front of the stored tables, and the table of cycles."""

import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsgraph.plans.load import load_records
from newsgraph.sinks.store import StarStore
from newsgraph.streaming.cycle import run_cycles
from newsgraph.streaming.progress import compact_days, read_cycles, watch

NOW = dt.datetime(2024, 1, 8, tzinfo=dt.timezone.utc)
COLUMNS = ["name", "designation", "state", "country", "email", "media_link", "linkedin_url", "website", "association",
           "about_info", "publication_date", "article_link", "sub_beat_topic", "feed"]


def to_records(rows):
    text = {c: F.lit(None).cast("string") for c in COLUMNS}
    return rows.select(
        *[(F.col(c) if c in rows.columns else text[c]).alias(c) for c in COLUMNS if c != "publication_date"],
        F.lit(None).cast("timestamp").alias("publication_date"), "article_title", "pos", F.lit(1).alias("beat_id"))


SCHEMA = "email string, article_title string, sub_beat_topic string, feed string, pos long"
KEYS = ["email", "article_title", "sub_beat_topic"]
FILES = [
    [("a@x", "t1", "s1", "f", 0), ("b@x", "t1", None, "f", 1)],
    [("a@x", "t1", "s1", "g", 0), ("b@x", "t1", None, "g", 1)],  # nothing new
    [("a@x", "t2", "s2", "h", 0), ("b@x", "t1", None, "h", 1)],
]


def land(spark, folder, files, begin=0):
    for i, rows_ in enumerate(files, begin):
        path = f"{folder}/part-{i}"
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.json(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_000_000_000 + 60 * i,) * 2)


@pytest.fixture
def lookups(monkeypatch):
    """The stored tables that were looked up or read, by load."""
    seen = []
    matching, read = StarStore.matching, StarStore.read
    monkeypatch.setattr(StarStore, "matching", lambda self, table, *a, **k: (seen.append(table), matching(self, table, *a, **k))[1])
    monkeypatch.setattr(StarStore, "read", lambda self, table, *a, **k: (seen.append(table), read(self, table, *a, **k))[1])
    return seen


def start(spark, folder, store, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    return run_cycles(stream, store, checkpoint, to_records, keys=KEYS, once=True, one_per_contact=False, now=NOW, **options)


def star(store):
    return rows(store.read("article").join(store.read("journalist"), "journalist_id"), "email", "article_title"), rows(
        store.read("sub_beat"), "sub_beat_topic"), store.read("article_subbeat").count()


def test_known_keys_read_no_stored_table(spark, tmp_path, lookups):
    folder, store = tmp_path / "landing", StarStore(spark, str(tmp_path / "s"))
    batches = StarStore(spark, str(tmp_path / "b"))
    for i, file in enumerate(FILES):
        land(spark, folder, [file], i)
        before = len(lookups)
        start(spark, folder, store, str(tmp_path / "c")).awaitTermination()  # a restart with its state each time
        assert (len(lookups) == before) == (i == 1)
    for file in FILES:
        load_records(batches, to_records(spark.createDataFrame(file, SCHEMA)), one_per_contact=False, now=NOW)
    assert star(store) == star(batches)
    assert [r["records"] for r in store.read("run_log").orderBy("run_no").collect()] == [2, 0, 1]


def test_forgotten_keys_are_decided_by_the_tables(spark, tmp_path):
    folder, store = tmp_path / "landing", StarStore(spark, str(tmp_path / "s"))
    schema = SCHEMA + ", at timestamp"
    times = [NOW, NOW + dt.timedelta(days=9), NOW + dt.timedelta(days=9, hours=1)]
    for i, at in enumerate(times):
        spark.createDataFrame([("a@x", "t1" if i != 1 else "t2", "s1", "f", 0, at)], schema).coalesce(1).write.json(f"{folder}/part-{i}")
        stream = spark.readStream.schema(schema).json(f"{folder}/*")
        run_cycles(stream, store, str(tmp_path / "c"), to_records, keys=KEYS, event_time="at", forget_after="1 day",
                   once=True, one_per_contact=False, now=NOW).awaitTermination()
    assert star(store)[0] == [("a@x", "t1"), ("a@x", "t2")]


def test_cycles_are_on_record(spark, tmp_path):
    folder, store, path = tmp_path / "landing", StarStore(spark, str(tmp_path / "s")), str(tmp_path / "cycles")
    land(spark, folder, FILES)
    log = watch(spark, path)
    try:
        run = start(spark, folder, store, str(tmp_path / "c"))
        run.awaitTermination()
        assert log.wait_for_end(run.runId)
    finally:
        spark.streams.removeListener(log)
    got = read_cycles(spark, path)
    assert rows(got.where("rows > 0"), "batch", "rows", "name") == [(0, 2, "cycle"), (2, 1, "cycle")]
    assert got.where("event = 'start'").count() == got.where("event = 'end'").count() == 1
    before = rows(got)
    tomorrow = dt.datetime.now(dt.timezone.utc).date() + dt.timedelta(days=1)
    assert len(compact_days(spark, path, tomorrow)) >= 1
    assert rows(read_cycles(spark, path)) == before


def test_failure_is_on_record(spark, tmp_path):
    folder, path = tmp_path / "landing", str(tmp_path / "cycles")
    land(spark, folder, FILES[:1])
    log = watch(spark, path)
    stream = spark.readStream.schema(SCHEMA).json(f"{folder}/*")

    def fail(rows_):
        raise RuntimeError("lost")

    try:
        run = run_cycles(stream, StarStore(spark, str(tmp_path / "s")), str(tmp_path / "c"), fail, once=True)
        with pytest.raises(Exception, match="lost"):
            run.awaitTermination()
        assert log.wait_for_end(run.runId)
    finally:
        spark.streams.removeListener(log)
    assert "lost" in read_cycles(spark, path).where("event = 'end'").first()["message"]
