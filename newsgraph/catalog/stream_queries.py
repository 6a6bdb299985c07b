"""Streaming queries: the events table through the micro-batch load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.catalog import views as v
from newsgraph.catalog.load_queries import NOW, new_store
from newsgraph.catalog.registry import query
from newsgraph.sinks.store import StarStore
from newsgraph.staging import new_path
from newsgraph.streaming.cycle import run_cycles
from newsgraph.streaming.progress import CycleLog, read_cycles, watch


def event_records(events: DataFrame) -> DataFrame:
    """Events as crawl records: user = contact, event type = article and topic."""
    user = F.col("user_id").cast("string")
    null = F.lit(None).cast("string")
    return events.select(
        F.concat(F.lit("User "), user).alias("name"), null.alias("designation"),
        null.alias("state"), null.alias("country"),
        F.concat(F.lit("u"), user, F.lit("@example.com")).alias("email"),
        null.alias("media_link"), null.alias("linkedin_url"), null.alias("website"),
        null.alias("association"), null.alias("about_info"),
        F.col("ts").cast("timestamp").alias("publication_date"),
        F.col("event_type").alias("article_title"),
        F.concat(F.lit("http://news.example.com/"), F.col("event_type")).alias("article_link"),
        F.col("event_type").alias("sub_beat_topic"), F.lit(1).alias("beat_id"),
        F.lit("events").alias("feed"), F.col("event_id").alias("pos"),
    )


#: an event of this user and kind stores nothing when there was one before
EVENT_KEYS = ["user_id", "event_type"]


def _streamed(spark, stream: DataFrame, keys=None, log: CycleLog | None = None) -> StarStore:
    store = new_store(spark)
    run = run_cycles(
        stream, store, new_path(spark, "checkpoint"), event_records,
        name="events", once=True, keys=keys, one_per_contact=False, now=NOW,
    )
    run.awaitTermination()
    if log:
        log.wait_for_end(run.runId)
    return store


def _landed(spark, sf) -> DataFrame:
    """The landing folder as a stream."""
    return (
        spark.readStream.schema(v.table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )


def _in_batches(spark, sf, batches: int = 3) -> DataFrame:
    """The same events landed as several files, one micro-batch each."""
    events = v.table(spark, sf, "events")
    path = new_path(spark, "landing")
    events.repartitionByRange(batches, "ts").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _written(store: StarStore) -> DataFrame:
    people = store.read("journalist").select("journalist_id", "email")
    return (
        store.read("article").join(people, "journalist_id")
        .groupBy("email").agg(F.count(F.lit(1)).alias("articles"),
                              F.min("article_title").alias("first_title"))
    )


_WRITTEN_SQL = """SELECT 'u' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
  count(DISTINCT event_type) AS articles, min(event_type) AS first_title
FROM events GROUP BY user_id"""


@query("stm_1_micro_batch", _WRITTEN_SQL)
def micro_batch(spark, sf):
    return _written(_streamed(spark, _landed(spark, sf)))


@query("stm_2_stream_dedupe", _WRITTEN_SQL)
def stream_dedupe(spark, sf):
    """Several micro-batches, with the keys seen so far in the state of the
    stream, give the tables that one batch gives."""
    return _written(_streamed(spark, _in_batches(spark, sf), EVENT_KEYS))


@query(
    "stm_3_progress_log",
    """SELECT 1 AS started, 1 AS ended, 3 AS runs, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS records,
  CAST(count(DISTINCT (user_id, event_type)) AS BIGINT) AS new_articles FROM events""",
)
def progress_log(spark, sf):
    """Cycles by the table that the listener writes, loads by the run log."""
    path = new_path(spark, "cycles")
    listener = watch(spark, path)
    try:
        store = _streamed(spark, _in_batches(spark, sf), log=listener)
    finally:
        spark.streams.removeListener(listener)
    count = lambda event: F.count_if(F.col("event") == event).cast("int")
    # a trigger that finds nothing reports a progress without rows
    cycles = read_cycles(spark, path).where("event <> 'progress' or rows > 0").agg(
        count("start").alias("started"), count("end").alias("ended"), count("progress").alias("runs"), F.sum("rows").alias("rows"))
    loads = store.read("run_log").agg(F.sum("records").alias("records"), F.sum("new_articles").alias("new_articles"))
    return cycles.join(loads)
