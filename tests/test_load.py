"""Loads: ids, idempotence, replay, one switch for all tables, defect cases."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsgraph.plans.load import load_records
from newsgraph.schemas import JOURNALIST
from newsgraph.sinks.changelog import read_log
from newsgraph.sinks.store import StarStore, mapped

NOW = dt.datetime(2016, 12, 7, 8, 0, 0, tzinfo=dt.timezone.utc)
COLUMNS = "email string, name string, article_title string, article_link string, sub_beat_topic string, beat_id int, pos long"


def records(spark, data):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], COLUMNS)
    return df.select(
        "*", F.lit("f").alias("feed"), F.lit(0).alias("journalist_id"),
        F.lit(None).cast("int").alias("article_id"), F.timestamp_seconds(F.lit(1480932000)).alias("publication_date"),
        *(F.lit(None).cast("string").alias(c) for c in (
            "designation", "state", "country", "media_link", "linkedin_url", "website", "association", "about_info")),
    )


FIRST = [
    (" Jane@example.com", "Jane", "T1", "l1", "Rates", 1),
    ("ann@example.com", "Ann", "T2", "l2", None, 1),
    ("jane@EXAMPLE.com ", "Jane again", "T3", "l3", "Rent", 2),
]
SECOND = [
    ("jane@example.com", "Jane", "T1", "l1", "Fresh", 1),  # stored article
    ("ann@example.com", "Ann", "T9", "l9", "Rates", 3),
    ("bob@example.com", "Bob", "T1", "l1", "", 3),
    ("cy@example.com", "Cy", None, "l5", "Rent", 4),
]


@pytest.fixture
def store(spark, tmp_path):
    return StarStore(spark, str(tmp_path / "store"))


def facts(store):
    """The stored star joined back by natural keys."""
    return rows(
        store.read("article").join(store.read("journalist"), "journalist_id")
        .join(store.read("article_subbeat"), "article_id", "left")
        .join(store.read("sub_beat"), "sub_beat_id", "left"),
        "email", "article_title", "sub_beat_topic", "beat_id")


def test_two_loads(spark, store):
    done = load_records(store, records(spark, FIRST), now=NOW)
    assert (done.records, done.rows["journalist"], done.rows["article"]) == (2, 2, 2)
    assert rows(store.read("journalist"), "journalist_id", "email", "name") == [
        (1, "ann@example.com", "Ann"), (2, "Jane@example.com", "Jane")]
    load_records(store, records(spark, SECOND), now=NOW)
    assert rows(store.read("journalist"), "journalist_id", "email") == [
        (1, "ann@example.com"), (2, "Jane@example.com"), (3, "bob@example.com"), (4, "cy@example.com")]
    assert rows(store.read("article"), "article_id", "article_title", "journalist_id") == [
        (1, "T1", 2), (2, "T2", 1), (3, "", 4), (4, "T1", 3), (5, "T9", 1)]
    # the topic of the stored article is kept as a topic but has no bridge row
    assert rows(store.read("sub_beat"), "sub_beat_id", "sub_beat_topic", "beat_id") == [
        (1, "Rates", 1), (2, "Fresh", 1), (3, "Rent", 4)]
    bridge = rows(store.read("article_subbeat"))
    assert bridge == [(1, 1, 1), (2, 2, 0), (3, 3, 3), (4, 4, 0), (5, 5, 1)]


def test_same_batch_twice_adds_nothing(spark, store):
    load_records(store, records(spark, SECOND), now=NOW)
    before = {t: rows(store.read(t)) for t in ("journalist", "article", "sub_beat", "article_subbeat")}
    again = load_records(store, records(spark, SECOND), now=NOW)
    assert again.rows["journalist"] == again.rows["article"] == 0
    assert before == {t: rows(store.read(t)) for t in before}
    assert store.read("run_log").count() == 2


def test_replayed_source_batch_is_skipped(spark, store):
    load_records(store, records(spark, FIRST), source="s", source_batch=0, now=NOW)
    assert load_records(store, records(spark, SECOND), source="s", source_batch=0, now=NOW).skipped
    assert not load_records(store, records(spark, SECOND), source="s", source_batch=1, now=NOW).skipped
    assert store.manifest()["version"] == 2


def test_failed_load_shows_nothing_and_can_be_repeated(spark, store, monkeypatch):
    load_records(store, records(spark, FIRST), now=NOW)
    before = facts(store)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("newsgraph.plans.load.load_bridge", fail)
        with pytest.raises(RuntimeError):
            load_records(store, records(spark, SECOND), now=NOW)
    assert facts(store) == before and store.read("article").count() == 2
    load_records(store, records(spark, SECOND), now=NOW)
    assert store.read("article").count() == 5
    assert rows(store.read("article_subbeat").select("article_id").distinct()) == [(i,) for i in range(1, 6)]


def test_second_writer_is_refused(spark, store):
    one, two = store.begin(), store.begin()
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()


def test_all_articles_of_a_contact(spark, store):
    load_records(store, records(spark, FIRST), one_per_contact=False, now=NOW)
    assert facts(store) == [
        ("Jane@example.com", "T1", "Rates", 1), ("Jane@example.com", "T3", "Rent", 2),
        ("ann@example.com", "T2", None, None)]


def test_all_topics_of_an_article(spark, store):
    item = lambda mail, title, topic, pos: (mail, "N", title, "l", topic, 1, pos)
    data = [item("a@example.com", "T1", "Rates", 0), item("a@example.com", "T1", "Rent", 0),
            item("a@example.com", "T1", "Rent", 0), item("b@example.com", "T2", None, 1),
            item("a@example.com", "T3", "Late", 2)]
    df = spark.createDataFrame(data, COLUMNS).select("*", F.lit("f").alias("feed"))
    base = records(spark, FIRST).drop(*df.columns)
    df = df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema))
    load_records(store, df, topics="all", now=NOW)
    assert facts(store) == [
        ("a@example.com", "T1", "Rates", 1), ("a@example.com", "T1", "Rent", 1), ("b@example.com", "T2", None, None)]
    assert rows(store.read("article_subbeat"), "article_subbeats_id", "article_id") == [(1, 1), (2, 1), (3, 2)]
    assert load_records(store, df, topics="all", now=NOW).rows["article"] == 0


def test_default_topic(spark, store):
    data = [("a@example.com", "A", "T1", "l", "Other", 7), ("b@example.com", "B", "T2", "l", "", 7)]
    load_records(store, records(spark, data), now=NOW)
    assert rows(store.read("article_subbeat"), "article_id", "sub_beat_id") == [(1, 1), (2, 1)]


def test_topic_under_two_beats_is_one_row(spark, store):
    data = [("a@example.com", "A", "T1", "l", "Rates", 5), ("b@example.com", "B", "T2", "l", "Rates", 2)]
    load_records(store, records(spark, data), now=NOW)
    assert rows(store.read("sub_beat")) == [(1, "Rates", 2)]


def test_empty_batch(spark, store):
    done = load_records(store, records(spark, FIRST).where("false"), now=NOW)
    assert done.records == 0 and store.read("journalist").count() == 0


def test_ids_are_unique_and_consecutive(spark, store):
    for low in (0, 30):
        data = [(f"u{i}@example.com", "n", f"t{i % 7}", "l", f"topic {i % 11}", i % 3) for i in range(low, low + 60)]
        load_records(store, records(spark, data), now=NOW)
    for table, column in [("journalist", "journalist_id"), ("article", "article_id"),
                          ("sub_beat", "sub_beat_id"), ("article_subbeat", "article_subbeats_id")]:
        ids = sorted(r[0] for r in store.read(table).select(column).collect())
        assert ids == list(range(1, len(ids) + 1)), table


def test_change_log_and_compaction(spark, store, tmp_path):
    root = str(tmp_path / "log")
    load_records(store, records(spark, FIRST), log_root=root, now=NOW)
    load_records(store, records(spark, SECOND), log_root=root, now=NOW)
    assert rows(read_log(spark, root), "email", "log_date") == [
        ("Jane@example.com", dt.date(2016, 12, 7)), ("ann@example.com", dt.date(2016, 12, 7)),
        ("bob@example.com", dt.date(2016, 12, 7)), ("cy@example.com", dt.date(2016, 12, 7))]
    before = facts(store)
    assert store.compact("article") == 2 and len(store.manifest()["segments"]["article"]) == 1
    assert facts(store) == before
    assert store.vacuum(keep=1) == ["article/seg-000000000001", "article/seg-000000000002"]
    assert facts(store) == before
    load_records(store, records(spark, SECOND), now=NOW)
    assert facts(store) == before


def test_run_log(spark, store):
    load_records(store, records(spark, FIRST), source="x", source_batch=4, now=NOW)
    row = store.read("run_log").first().asDict()
    assert (row["run_no"], row["source"], row["source_batch"], row["records"]) == (1, "x", 4, 2)
    assert (row["new_journalists"], row["new_articles"], row["new_sub_beats"], row["new_bridges"]) == (2, 2, 1, 2)
    assert row["message"] == "Run 1 completed on 07/12/2016 08:00:00; 2 records loaded."
    assert "@" not in str(row)


def test_mapped_columns(spark):
    df = spark.sql("select 5 journalist_id, 'n' name, 'e' email, 1 extra")
    got = mapped(df, JOURNALIST, ["name", "email"])
    assert got.schema == JOURNALIST.jsonValue() or got.columns == JOURNALIST.fieldNames()
    assert got.first()["journalist_id"] is None and got.first()["name"] == "n"


def test_log_lost_between_commit_and_write_is_written_by_the_replay(spark, tmp_path, monkeypatch):
    """The load is committed, its log is not written: the replay is skipped and writes the log."""
    from newsgraph.plans import load as plan
    from newsgraph.sinks.changelog import log_written, read_log

    store, root = StarStore(spark, str(tmp_path / "s")), str(tmp_path / "log")
    now = dt.datetime(2024, 1, 8, tzinfo=dt.timezone.utc)
    records = spark.createDataFrame(
        [("A", "a@x", "t1", "f", 0), ("B", "b@x", "t2", "f", 1)], "name string, email string, article_title string, feed string, pos long")
    for c in ("designation", "state", "country", "media_link", "linkedin_url", "website", "association", "about_info",
              "article_link", "sub_beat_topic"):
        records = records.withColumn(c, F.lit(None).cast("string"))
    records = records.withColumn("publication_date", F.lit(None).cast("timestamp")).withColumn("beat_id", F.lit(0))
    options = dict(source="s", source_batch=1, log_root=root, now=now)

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(plan, "write_log", lost)
        with pytest.raises(OSError):
            load_records(store, records, **options)
    assert store.read("journalist").count() == 2 and not log_written(spark, root, now.date(), 1)
    assert load_records(store, records, **options).skipped
    assert sorted(r["email"] for r in read_log(spark, root).collect()) == ["a@x", "b@x"]
    # a log that retention has removed since is not written again
    store2 = StarStore(spark, str(tmp_path / "s2"))
    with monkeypatch.context() as patch:
        patch.setattr(plan, "write_log", lost)
        with pytest.raises(OSError):
            load_records(store2, records, **{**options, "log_root": root + "2"})
    load_records(store2, records, **{**options, "log_root": root + "2", "now": now + dt.timedelta(days=9)})
    assert not log_written(spark, root + "2", now.date(), 1)
