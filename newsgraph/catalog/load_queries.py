"""Sinks and loads: every query writes a store of its own and reads it back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Observation, functions as F

from newsgraph.catalog import views as v
from newsgraph.catalog.registry import query
from newsgraph.operators.numbering import dense_numbers
from newsgraph.plans import load as ld
from newsgraph.sinks.changelog import kept, log_layout, read_log, write_log
from newsgraph.sinks.store import StarStore
from newsgraph.staging import new_path, stage

NOW = dt.datetime(2024, 1, 31, 12, 0, 0, tzinfo=dt.timezone.utc)


def new_store(spark) -> StarStore:
    return StarStore(spark, new_path(spark, "store"))


def loaded_store(spark, sf: str) -> StarStore:
    """A store after two loads: the earlier orders, then the later ones."""
    store = new_store(spark)
    for orders in v.orders_split(spark, sf):
        ld.load_records(
            store, v.order_records(spark, sf, orders), one_per_contact=False, now=NOW
        )
    return store


@query(
    "snk_1_mapped_append",
    f"""WITH {v.CONTACTS}
SELECT row_number() OVER (ORDER BY email) AS journalist_id, name, state, email, association,
  CAST(NULL AS VARCHAR) AS country FROM contacts""",
)
def mapped_append(spark, sf):
    store = new_store(spark)
    load = store.begin()
    rows = dense_numbers(v.contacts(spark, sf), ["email"], "journalist_id")
    load.add("journalist", rows, ["journalist_id", "name", "state", "email", "association"])
    load.commit()
    return store.read("journalist").select("journalist_id", "name", "state", "email", "association", "country")


@query("snk_2_rows_copied", "SELECT count(*) AS rows_copied FROM orders")
def rows_copied(spark, sf):
    copied = Observation()
    orders = v.table(spark, sf, "orders").select("o_orderkey")
    orders.observe(copied, F.count(F.lit(1)).alias("n")).write.parquet(new_path(spark, "copied"))
    return spark.range(1).select(F.lit(copied.get["n"]).cast("bigint").alias("rows_copied"))


def _log_rows(spark, sf):
    """Customers as journalist rows; the about text holds quotes and commas."""
    null = F.lit(None).cast("string")
    return v.contacts(spark, sf).select(
        F.col("c_custkey").alias("journalist_id"), "name", null.alias("designation"),
        null.alias("tags"), "state", null.alias("country"), "email", null.alias("media_link"),
        F.lit("http://linkedin.com/x").alias("linkedin_url"), null.alias("website"), "association",
        F.concat(F.lit('He said "'), F.col("name"), F.lit('", twice\nand left')).alias("about_info"),
    )


@query(
    "snk_3_change_log",
    f"""WITH {v.CONTACTS}
SELECT email, name, state, CAST(NULL AS VARCHAR) AS country, association, 'http://linkedin.com/x' AS linkedin_url,
  'He said "' || name || '", twice' || chr(10) || 'and left' AS about_info FROM contacts""",
)
def change_log(spark, sf):
    path = write_log(_log_rows(spark, sf), new_path(spark, "log"), NOW.date(), 1)
    return read_log(spark, path).select(
        "email", "name", "state", F.nullif("country", F.lit("")).alias("country"), "association",
        "linkedin_url", "about_info",
    )


@query(
    "snk_4_log_layout",
    f"""WITH {v.CONTACTS}
SELECT email, name, state, CAST(NULL AS VARCHAR) AS country, association,
  CAST(NULL AS VARCHAR) AS media_link, CAST(NULL AS VARCHAR) AS website,
  'He said "' || name || '", twice' || chr(10) || 'and left' AS about_info,
  'http://linkedin.com/x' AS linkedin_url FROM contacts""",
)
def layout(spark, sf):
    return log_layout(_log_rows(spark, sf))


@query(
    "snk_5_retention",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY",
)
def retention(spark, sf):
    events = v.table(spark, sf, "events")
    as_of = v.latest(events, "ts")
    return kept(events, "ts", as_of).select("event_id")


_JOURNALISTS = f"""{v.PEOPLE},
journalists AS (
  SELECT email, journalist_id FROM stored_contacts
  UNION ALL SELECT email, (SELECT count(*) FROM stored_contacts)
    + row_number() OVER (ORDER BY email) FROM incoming_contacts
  WHERE email NOT IN (SELECT email FROM stored_contacts))"""


@query(
    "pip_1_journalist_upsert",
    f"""WITH {_JOURNALISTS}
SELECT row_number() OVER (ORDER BY i.c_custkey) AS order_no, j.journalist_id
FROM incoming_contacts i JOIN journalists j ON j.email = i.email""",
)
def journalist_upsert(spark, sf):
    stored, incoming = v.orders_split(spark, sf)
    store = new_store(spark)
    load = store.begin()
    load.add("journalist", v.stored_contacts(spark, sf, stored))
    load.commit()
    batch = dense_numbers(v.incoming_contacts(spark, sf, incoming), ["c_custkey"], "order_no")
    records = ld.prepare(
        batch.select(
            *(F.col(c) if c in batch.columns else F.lit(None).cast("string").alias(c)
              for c in ld.JOURNALIST_COLUMNS),
            F.lit("").alias("article_title"), F.lit("").alias("feed"), F.col("order_no").alias("pos"),
        )
    )
    ids, _ = ld.upsert_journalists(store.begin(), stage(records))
    return batch.join(ids.withColumnRenamed("email_key", "email"), "email").select(
        "order_no", "journalist_id"
    )


_ARTICLES = f"""{_JOURNALISTS}, {v.BEATS}, {v.FIRST_PARTS}, {v.ORDER_RECORDS},
placed AS (SELECT r.*, j.journalist_id, r.o_orderdate >= (SELECT d FROM cut) AS later
  FROM order_records r JOIN journalists j ON j.email = r.email),
articles AS (SELECT *, row_number() OVER (ORDER BY later, article_title, journalist_id) AS article_id
  FROM placed)"""


@query(
    "pip_2_article_load",
    f"""WITH {_ARTICLES}
SELECT article_id, strftime(o_orderdate, '%Y-%m-%d') AS day, article_title, article_link, journalist_id
FROM articles""",
)
def article_load(spark, sf):
    return loaded_store(spark, sf).read("article").select(
        "article_id", F.date_format("publication_date", "yyyy-MM-dd").alias("day"),
        "article_title", "article_link", "journalist_id",
    )


_SUB_BEATS = f"""{_ARTICLES},
first_topics AS (SELECT sub_beat_topic, min(beat_id) AS beat_id FROM articles
  WHERE sub_beat_topic <> '' AND NOT later GROUP BY 1),
later_topics AS (SELECT sub_beat_topic, min(beat_id) AS beat_id FROM articles
  WHERE sub_beat_topic <> '' AND later
    AND sub_beat_topic NOT IN (SELECT sub_beat_topic FROM first_topics) GROUP BY 1),
sub_beats AS (SELECT sub_beat_topic, beat_id, row_number() OVER (ORDER BY later, sub_beat_topic) AS sub_beat_id
  FROM (SELECT *, false AS later FROM first_topics UNION ALL SELECT *, true FROM later_topics))"""


@query(
    "pip_3_topic_upsert",
    f"WITH {_SUB_BEATS} SELECT sub_beat_id, sub_beat_topic, beat_id FROM sub_beats",
)
def topic_upsert(spark, sf):
    return loaded_store(spark, sf).read("sub_beat")


@query(
    "pip_4_bridge_load",
    f"""WITH {_SUB_BEATS}
SELECT article_id AS article_subbeats_id, article_id, coalesce(s.sub_beat_id, 0) AS sub_beat_id
FROM articles a LEFT JOIN sub_beats s ON s.sub_beat_topic = a.sub_beat_topic""",
)
def bridge_load(spark, sf):
    return loaded_store(spark, sf).read("article_subbeat")


@query(
    "pip_5_full_load",
    f"""WITH {_SUB_BEATS}
SELECT coalesce(s.beat_id, 0) AS beat_id, count(*) AS articles,
  count(DISTINCT a.journalist_id) AS journalists, count(DISTINCT s.sub_beat_id) AS sub_beats
FROM articles a LEFT JOIN sub_beats s ON s.sub_beat_topic = a.sub_beat_topic GROUP BY 1""",
)
def full_load(spark, sf):
    store = loaded_store(spark, sf)
    return star_counts(store)


def star_counts(store: StarStore):
    """Articles, journalists and topics per beat, read from the stored tables."""
    articles, bridge = store.read("article"), store.read("article_subbeat")
    return (
        articles.join(bridge, "article_id")
        .join(store.read("sub_beat").withColumnRenamed("sub_beat_id", "_id"),
              F.col("sub_beat_id") == F.col("_id"), "left")
        .groupBy(F.coalesce("beat_id", F.lit(0)).alias("beat_id"))
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.countDistinct("journalist_id").alias("journalists"),
            F.countDistinct("_id").alias("sub_beats"),
        )
    )


@query(
    "agg_3_run_counters",
    f"""WITH {_SUB_BEATS},
runs AS (SELECT CASE WHEN later THEN 2 ELSE 1 END AS run_no, count(*) AS n FROM articles GROUP BY 1)
SELECT CAST(run_no AS BIGINT) AS run_no, n AS records, n AS new_articles, n AS new_bridges,
  CASE run_no WHEN 1 THEN (SELECT count(*) FROM stored_contacts)
    ELSE (SELECT count(*) FROM incoming_contacts
          WHERE email NOT IN (SELECT email FROM stored_contacts)) END AS new_journalists,
  CASE run_no WHEN 1 THEN (SELECT count(*) FROM first_topics)
    ELSE (SELECT count(*) FROM later_topics) END AS new_sub_beats,
  'Run ' || CAST(run_no AS VARCHAR) || ' completed on 31/01/2024 12:00:00; '
    || CAST(n AS VARCHAR) || ' records loaded.' AS message
FROM runs""",
)
def run_counters(spark, sf):
    return loaded_store(spark, sf).read("run_log").select(
        "run_no", "records", "new_articles", "new_bridges", "new_journalists", "new_sub_beats", "message"
    )
