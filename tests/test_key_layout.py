"""Stored tables laid out by key: a small batch opens a part of the files, results stay the same."""

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import lookups as lk
from newsgraph.sinks import key_layout
from newsgraph.sinks.store import StarStore
from tests.conftest import rows

ROWS = 6400


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two segments of articles in many ranges, one in a single range."""
    out = StarStore(spark, str(tmp_path_factory.mktemp("keyed")), range_rows=100)
    for begin, end in ((0, ROWS), (ROWS, 2 * ROWS), (2 * ROWS, 2 * ROWS + 50)):
        load = out.begin()
        load.add("article", spark.range(begin, end).select(
            F.col("id").alias("article_id"), F.concat(F.lit("t"), "id").alias("article_title"),
            (F.col("id") % 97).alias("journalist_id")), ["article_id", "article_title", "journalist_id"])
        load.commit()
    return out


def batch(spark, *ids):
    return spark.createDataFrame([(f"t{i}", i % 97) for i in ids], "article_title string, journalist_id long")


KEY = ["article_title", "journalist_id"]


def test_manifest_names_the_ranges(store):
    first, second, third = store.manifest()["segments"]["article"]
    assert first["bits"] == second["bits"] == 6 and len(first["ranges"]) == 64
    assert third["bits"] == 0 and third["ranges"] == [0]
    assert store.read("article").count() == 2 * ROWS + 50


def test_small_batch_opens_a_part_of_the_files(spark, store):
    every = len(store.read("article").inputFiles())
    found = store.matching("article", batch(spark, 5, 4711, 2 * ROWS + 3), KEY)
    assert len(found.inputFiles()) <= 3 * 2 + 4 < every / 10  # the single range has a file per task
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key_hash" in plan
    assert {r[0] for r in rows(found, "article_id")} == {5, 4711, 2 * ROWS + 3}


def test_large_batch_and_unknown_keys(spark, store, monkeypatch):
    assert rows(store.matching("article", batch(spark, -1), KEY)) == []
    monkeypatch.setattr(key_layout, "LOOKUP_KEYS", 2)
    monkeypatch.setattr(key_layout.batch_hashes, "__defaults__", (2,))
    whole = store.matching("article", batch(spark, 1, 2, 3), KEY)
    assert whole.count() == 2 * ROWS + 50


@pytest.mark.parametrize("ids", [(), (3, 3, 10**9), (1, 2, 3, 7000, 12_810)])
def test_lookups_equal_those_of_the_whole_table(spark, store, ids):
    wanted = batch(spark, *ids)
    part, whole = store.matching("article", wanted, KEY), store.read("article")
    assert rows(lk.with_existence(wanted, part, KEY, "article_id")) == rows(lk.with_existence(wanted, whole, KEY, "article_id"))
    assert rows(lk.not_stored(wanted, part, KEY)) == rows(lk.not_stored(wanted, whole, KEY))
    assert rows(lk.already_stored(wanted, part, KEY, "article_id")) == rows(lk.already_stored(wanted, whole, KEY, "article_id"))


def test_null_and_equal_keys(spark, tmp_path):
    out = StarStore(spark, str(tmp_path))
    load = out.begin()
    load.add("article", spark.createDataFrame(
        [(1, None, 5), (2, "a", None), (3, "a", 5), (4, "a", 5)], "article_id long, article_title string, journalist_id long"))
    load.commit()
    wanted = spark.createDataFrame([(None, 5), ("a", 5)], "article_title string, journalist_id long")
    found = lk.stored_ids(wanted, out.matching("article", wanted, KEY), KEY, "article_id")
    assert rows(found) == [("a", 5, 3)]


def test_two_adds_of_one_load_keep_their_rows(spark, tmp_path):
    out = StarStore(spark, str(tmp_path))
    load = out.begin()
    for ids in ((1, 2, 3), (10, 11)):
        load.add("journalist", spark.createDataFrame([(i, f"{i}@x.com") for i in ids], "journalist_id long, email string"))
    assert load.added("journalist").count() == 5 and load.rows["journalist"] == 5
    load.commit()
    assert rows(out.read("journalist"), "journalist_id") == [(1,), (10,), (11,), (2,), (3,)]


def test_compaction_keeps_ranges(spark, tmp_path):
    out = StarStore(spark, str(tmp_path), range_rows=100)
    for n in range(3):
        load = out.begin()
        load.add("sub_beat", spark.range(200 * n, 200 * n + 200).select(
            F.col("id").alias("sub_beat_id"), F.concat(F.lit("s"), "id").alias("sub_beat_topic"), F.lit(1).alias("beat_id")))
        load.commit()
    assert out.compact("sub_beat", small_rows=1000) == 3
    (segment,) = out.manifest()["segments"]["sub_beat"]
    assert segment["bits"] == 3 and segment["rows"] == 600
    wanted = spark.createDataFrame([("s7",), ("s599",)], "sub_beat_topic string")
    found = out.matching("sub_beat", wanted, ["sub_beat_topic"])
    assert rows(found, "sub_beat_id") == [(599,), (7,)] and len(found.inputFiles()) <= 2


def test_range_bits():
    assert [key_layout.range_bits(n, 100) for n in (0, 1, 100, 101, 200, 201, 10**9)] == [0, 0, 0, 1, 1, 2, 12]
    assert key_layout.range_of(-1, 4) == 15 and key_layout.range_of(1 << 62, 2) == 1
