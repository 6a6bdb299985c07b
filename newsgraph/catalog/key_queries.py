"""Lookup, existence, ordering and id queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.catalog import views as v
from newsgraph.catalog.feed_queries import language_beats
from newsgraph.catalog.load_queries import new_store
from newsgraph.catalog.registry import query
from newsgraph.operators import lookups as lk
from newsgraph.operators.numbering import by_order, dense_numbers, newest_ids


@query(
    "jon_1_item_guid",
    """SELECT o_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag)) AS l_returnflag
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def item_guid(spark, sf):
    lines = v.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lk.first_match(
        v.table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", "l_returnflag",
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"],
    )


@query(
    "jon_2_item_channel",
    """SELECT c_nationkey, c_custkey, n_name FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def item_channel(spark, sf):
    channels = v.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return lk.first_match(
        v.table(spark, sf, "customer").select("c_nationkey", "c_custkey"), channels, "c_nationkey",
        "n_name", ["n_name"],
    )


@query(
    "jon_3_beat_id",
    f"""WITH {v.PAGE_ITEMS},
langs AS (SELECT lang AS beat_topic, CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS beat_id
  FROM (SELECT DISTINCT CASE WHEN lang = 'es' THEN 'other' ELSE lang END AS lang FROM documents))
SELECT item_id, ' ' || category || ' ' AS beat, coalesce(beat_id, 0) AS beat_id
FROM page_items LEFT JOIN langs ON beat_topic = category""",
)
def beat_id(spark, sf):
    items = v.page_items(spark, sf).select(
        "item_id", F.concat(F.lit(" "), F.col("category"), F.lit(" ")).alias("beat")
    )
    return lk.beat_ids(items, language_beats(spark, sf))


def _people(spark, sf):
    """(stored journalists, incoming contacts) of the order split."""
    stored, incoming = v.orders_split(spark, sf)
    return (
        v.stored_contacts(spark, sf, stored).select("email", "journalist_id"),
        v.incoming_contacts(spark, sf, incoming),
    )


def _stored(spark, table, rows, batch, *keys):
    """The rows as a stored table, and of that what the files with keys of the batch hold."""
    store = new_store(spark)
    load = store.begin()
    load.add(table, rows)
    load.commit()
    return store.matching(table, batch, keys)


@query(
    "jon_4_existing_journalists",
    f"""WITH {v.PEOPLE}
SELECT i.email, s.journalist_id IS NOT NULL AS is_exist, coalesce(s.journalist_id, 0) AS journalist_id
FROM incoming_contacts i LEFT JOIN stored_contacts s ON s.email = i.email""",
)
def existing_journalists(spark, sf):
    stored, incoming = _people(spark, sf)
    stored = _stored(spark, "journalist", stored, incoming, "email")
    return lk.with_existence(incoming.select("email"), stored, ["email"], "journalist_id")


def _topics(spark, sf):
    """(stored topics, all topics): name, brand and size of the parts; stored
    are those of the parts on stored orders."""
    stored_orders, _ = v.orders_split(spark, sf)
    parts = _part_topics(spark, sf)
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")
    )
    sold = lines.join(stored_orders.select("o_orderkey"), "o_orderkey", "left_semi")
    known = parts.join(sold, "p_partkey", "left_semi").select("sub_beat_topic").distinct()
    stored = dense_numbers(known, ["sub_beat_topic"], "sub_beat_id")
    topics = parts.groupBy("sub_beat_topic").agg(F.min("p_size").alias("beat_id"))
    return stored, topics


def _part_topics(spark, sf):
    size = F.col("p_size").cast("string")
    return v.table(spark, sf, "part").select(
        "p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_brand", size).alias("sub_beat_topic")
    )


_STORED_TOPICS = f"""{v.ORDERS_SPLIT},
part_topics AS (SELECT p_partkey, p_size,
    p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) AS sub_beat_topic FROM part),
stored_topics AS (
  SELECT sub_beat_topic, row_number() OVER (ORDER BY sub_beat_topic) AS sub_beat_id FROM (
    SELECT DISTINCT sub_beat_topic FROM part_topics WHERE p_partkey IN (
      SELECT l_partkey FROM lineitem JOIN stored_orders ON l_orderkey = o_orderkey))),
topics AS (SELECT sub_beat_topic, min(p_size) AS beat_id FROM part_topics GROUP BY 1)"""


@query(
    "jon_5_existing_topics",
    f"""WITH {_STORED_TOPICS}
SELECT sub_beat_topic, t.beat_id, s.sub_beat_id IS NOT NULL AS is_exist,
  coalesce(s.sub_beat_id, 0) AS sub_beat_id
FROM topics t LEFT JOIN stored_topics s USING (sub_beat_topic)""",
)
def existing_topics(spark, sf):
    stored, topics = _topics(spark, sf)
    stored = _stored(spark, "sub_beat", stored, topics, "sub_beat_topic")
    return lk.with_existence(topics, stored, ["sub_beat_topic"], "sub_beat_id")


@query(
    "jon_6_stored_rows",
    f"""WITH {v.PEOPLE}
SELECT i.email, i.c_custkey, s.journalist_id
FROM incoming_contacts i JOIN stored_contacts s ON s.email = i.email""",
)
def stored_rows(spark, sf):
    stored, incoming = _people(spark, sf)
    stored = _stored(spark, "journalist", stored, incoming, "email")
    return lk.already_stored(incoming.select("email", "c_custkey"), stored, ["email"], "journalist_id")


@query(
    "jon_7_new_rows",
    f"""WITH {v.PEOPLE}
SELECT email, c_custkey FROM incoming_contacts
WHERE email NOT IN (SELECT email FROM stored_contacts)""",
)
def new_rows(spark, sf):
    stored, incoming = _people(spark, sf)
    stored = _stored(spark, "journalist", stored, incoming, "email")
    return lk.not_stored(incoming.select("email", "c_custkey"), stored, ["email"])


@query(
    "jon_8_new_articles",
    f"""WITH {v.ORDERS_SPLIT}
SELECT o_orderkey, o_orderpriority AS article_title, o_custkey AS journalist_id
FROM incoming_orders i WHERE NOT EXISTS (SELECT 1 FROM stored_orders s
  WHERE s.o_orderpriority = i.o_orderpriority AND s.o_custkey = i.o_custkey)""",
)
def new_articles(spark, sf):
    article = lambda df: df.select(
        "o_orderkey", F.col("o_orderpriority").alias("article_title"), F.col("o_custkey").alias("journalist_id")
    )
    stored, incoming = v.orders_split(spark, sf)
    keys = ["article_title", "journalist_id"]
    stored = _stored(spark, "article", article(stored).withColumnRenamed("o_orderkey", "article_id"), article(incoming), *keys)
    return lk.not_stored(article(incoming), stored, keys)


_ORDERED = f"""{v.PEOPLE},
batch AS (SELECT email, row_number() OVER (ORDER BY c_custkey) AS order_no FROM incoming_contacts),
fresh AS (SELECT email, (SELECT count(*) FROM stored_contacts) + row_number() OVER (ORDER BY email)
    AS journalist_id FROM incoming_contacts
  WHERE email NOT IN (SELECT email FROM stored_contacts)),
read_back AS (SELECT * FROM fresh UNION ALL SELECT email, journalist_id FROM stored_contacts)"""


def _batch(spark, sf):
    """(batch with order numbers, new ids, stored ids)."""
    stored, incoming = _people(spark, sf)
    stored = stored.select("email", "journalist_id")
    batch = dense_numbers(incoming.select("email", "c_custkey"), ["c_custkey"], "order_no")
    highest = stored.agg(F.coalesce(F.max("journalist_id"), F.lit(0))).first()[0]
    new = dense_numbers(
        lk.not_stored(batch.select("email"), stored, ["email"]), ["email"], "journalist_id", highest
    )
    return batch.select("email", "order_no"), new, stored


@query(
    "jon_9_id_read_back",
    f"""WITH {_ORDERED}
SELECT email, journalist_id, coalesce(order_no, 0) AS order_no
FROM read_back LEFT JOIN batch USING (email)""",
)
def id_read_back(spark, sf):
    batch, new, stored = _batch(spark, sf)
    return lk.restore_order(lk.merge_rows(new, stored), batch)


_WORK = f"""{_STORED_TOPICS},
work AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 = 1 THEN NULL
  ELSE sub_beat_topic END AS sub_beat_topic FROM part_topics),
other AS (SELECT coalesce(min(sub_beat_id), 0) AS id FROM stored_topics
  WHERE sub_beat_topic = (SELECT min(sub_beat_topic) FROM topics))"""


@query(
    "jon_10_topic_id",
    f"""WITH {_WORK}
SELECT p_partkey, w.sub_beat_topic, CASE WHEN coalesce(w.sub_beat_topic, '') = '' THEN other.id
  ELSE s.sub_beat_id END AS sub_beat_id
FROM work w CROSS JOIN other LEFT JOIN stored_topics s ON s.sub_beat_topic = w.sub_beat_topic""",
)
def topic_id(spark, sf):
    """The first topic by name plays the default topic."""
    stored, topics = _topics(spark, sf)
    size = F.col("p_size") % 7
    work = _part_topics(spark, sf).select(
        "p_partkey",
        F.when(size == 0, "").when(size != 1, F.col("sub_beat_topic")).alias("sub_beat_topic"),
    )
    first = topics.agg(F.min("sub_beat_topic")).first()[0]
    return lk.topic_ids(work, stored, lk.default_member_id(stored, first))


@query(
    "jon_11_default_member",
    f"""WITH {_STORED_TOPICS},
last_topic AS (SELECT max(sub_beat_topic) AS t FROM stored_topics)
SELECT (SELECT t FROM last_topic) AS topic, coalesce(min(sub_beat_id), 0) AS default_id
FROM stored_topics WHERE sub_beat_topic = (SELECT t FROM last_topic)
UNION ALL SELECT 'Other', coalesce(min(sub_beat_id), 0) FROM stored_topics
WHERE sub_beat_topic = 'Other'""",
)
def default_member(spark, sf):
    stored, _ = _topics(spark, sf)
    one = lambda t: lk.default_member_id(stored, t).select(F.lit(t).alias("topic"), "default_id")
    last = stored.agg(F.max("sub_beat_topic")).first()[0]
    return one(last).unionByName(one("Other"))


@query(
    "jon_12_zip_on_order",
    f"""WITH {_ORDERED}
SELECT b.order_no, b.email, r.journalist_id FROM batch b JOIN read_back r ON r.email = b.email""",
)
def zip_rows(spark, sf):
    batch, new, stored = _batch(spark, sf)
    ids = lk.restore_order(lk.merge_rows(new, stored), batch).where("order_no > 0")
    return lk.zip_on_order(batch, ids.select("order_no", "journalist_id"))


@query(
    "ord_1_newest_ids",
    f"""WITH {v.PEOPLE}
SELECT journalist_id, email FROM stored_contacts ORDER BY journalist_id DESC LIMIT 50""",
)
def newest(spark, sf):
    stored, _ = v.orders_split(spark, sf)
    return newest_ids(v.stored_contacts(spark, sf, stored), "journalist_id", 50, "email")


@query(
    "ord_2_sorted",
    "SELECT o_orderkey AS order_no, o_custkey AS journalist_id FROM orders ORDER BY order_no",
)
def sorted_rows(spark, sf):
    return by_order(
        v.table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("order_no"), F.col("o_custkey").alias("journalist_id")
        )
    )


@query(
    "ord_3_order_number",
    f"WITH {v.CONTACTS} SELECT email, row_number() OVER (ORDER BY email) AS order_no FROM contacts",
)
def order_number(spark, sf):
    return dense_numbers(v.contacts(spark, sf).select("email"), ["email"], "order_no")


@query("ord_4_surrogate_ids", f"WITH {_ORDERED} SELECT email, journalist_id FROM fresh")
def surrogate_ids(spark, sf):
    return _batch(spark, sf)[1]
