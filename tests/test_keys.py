import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsgraph.operators import lookups as lk
from newsgraph.operators.dedupe import distinct_pairs, first_per_email, first_per_key, one_row_per_topic
from newsgraph.operators.numbering import dense_numbers, newest_ids, newest_per_group


@pytest.mark.parametrize("count", [0, 1, 997])
def test_dense_numbers(spark, count):
    keys = [f"k{i:05d}" for i in range(count)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    got = {r["k"]: r["id"] for r in dense_numbers(df, ["k"], "id", 100).collect()}
    assert got == {k: 101 + i for i, k in enumerate(sorted(keys))}


def test_newest_per_group_is_exact_for_a_hot_group(spark):
    rnd = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 7}", rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, ts int, id int").repartition(5)
    got = newest_per_group(df, ["g"], [F.desc("ts"), F.asc("id")], 20, ["id"], slices=8)
    want = {}
    for g in {d[0] for d in data}:
        ordered = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))[:20]
        want.update({(g, d[2]): i + 1 for i, d in enumerate(ordered)})
    assert {(r["g"], r["id"]): r["rank"] for r in got.collect()} == want


def test_newest_ids(spark):
    df = spark.range(100).withColumnRenamed("id", "article_id")
    assert [r[0] for r in newest_ids(df, "article_id", 3).collect()] == [99, 98, 97]


def test_first_rows(spark):
    df = spark.createDataFrame([("A@x ", 2), ("a@X", 1), ("b@x", 3)], "email string, n int")
    assert rows(first_per_email(df, ["n"])) == [("a@X", 1), ("b@x", 3)]
    assert rows(first_per_key(df.withColumn("k", F.lit(1)), ["k"], ["n"]), "n") == [(1,)]


def test_topics_once(spark):
    df = spark.createDataFrame([("t", 2), ("t", 1), ("u", 3), ("t", 1)], "sub_beat_topic string, beat_id int")
    assert rows(distinct_pairs(df, "sub_beat_topic", "beat_id")) == [("t", 1), ("t", 2), ("u", 3)]
    assert rows(one_row_per_topic(df)) == [("t", 1), ("u", 3)]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("z", 9)], "email string, journalist_id long")


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame([("b", 1), ("c", 2), ("a", 3), ("d", 4)], "email string, order_no long")


def test_existence(batch, stored):
    got = lk.with_existence(batch, stored, ["email"], "journalist_id")
    assert rows(got, "email", "is_exist", "journalist_id") == [
        ("a", True, 1), ("b", True, 2), ("c", False, 0), ("d", False, 0)]


def test_semi_plus_anti_is_input(batch, stored):
    kept = lk.already_stored(batch, stored, ["email"], "journalist_id").select("email", "order_no")
    new = lk.not_stored(batch, stored, ["email"])
    assert rows(kept.unionByName(new)) == rows(batch)
    assert rows(new, "email") == [("c",), ("d",)]


def test_read_back_and_zip(spark, batch, stored):
    ids = lk.restore_order(stored, batch)
    assert rows(ids, "email", "order_no") == [("a", 3), ("b", 1), ("z", 0)]
    assert rows(lk.zip_on_order(batch, ids.drop("email").where("order_no > 0")), "email", "journalist_id") == [("a", 1), ("b", 2)]


def test_topic_back_fill(spark):
    topics = spark.createDataFrame([("t", 5), ("Other", 8)], "sub_beat_topic string, sub_beat_id long")
    work = spark.createDataFrame([(1, "t"), (2, ""), (3, None), (4, "gone")], "i int, sub_beat_topic string")
    got = lk.topic_ids(work, topics, lk.default_member_id(topics))
    assert rows(got, "i", "sub_beat_id") == [(1, 5), (2, 8), (3, 8), (4, None)]
    assert lk.default_member_id(topics, "Missing").first()[0] == 0


def test_beats_and_first_match(spark):
    beats = spark.createDataFrame([(1, "World"), (2, "Local")], "beat_id int, beat_topic string")
    items = spark.createDataFrame([(1, " World "), (2, "x"), (3, None)], "i int, beat string")
    assert rows(lk.beat_ids(items, beats), "i", "beat_id") == [(1, 1), (2, 0), (3, 0)]
    right = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "i int, v string, o int")
    assert rows(lk.first_match(items.select("i"), right, "i", "v", ["o"])) == [(1, "a"), (2, None), (3, None)]


def test_merge_rows(spark):
    got = lk.merge_rows(spark.sql("select 1 a, 2 b"), spark.sql("select 3 a, 4 c"))
    assert rows(got, "a", "b", "c") == [(1, 2, None), (3, None, 4)]
