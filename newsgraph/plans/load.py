"""Crawl records to the stored star schema.

Each step takes the open ``Load`` and returns what the next one needs. Every
lookup is one equi-join, and new ids are dense numbers after the stored
maximum, so a load does the same work on one task or on a thousand.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsgraph.functions.rows import split_on, trim_all, with_text
from newsgraph.operators.dedupe import first_per_key, one_row_per_topic
from newsgraph.operators.lookups import (
    default_member_id,
    merge_rows,
    not_stored,
    topic_ids,
    with_existence,
)
from newsgraph.operators.numbering import dense_numbers
from newsgraph.sinks.changelog import KEEP_DAYS, drop_old_logs, log_written, write_log
from newsgraph.sinks.store import Load, StarStore
from newsgraph.staging import scope, stage, stage_counted

JOURNALIST_COLUMNS = [
    "name", "designation", "state", "country", "email", "media_link", "linkedin_url",
    "website", "association", "about_info",
]
ARTICLE_COLUMNS = ["publication_date", "article_title", "article_link", "journalist_id"]
ORDER = ["feed", "pos"]
DEFAULT_TOPIC = "Other"
ARTICLE_KEY = ["article_title", "journalist_id"]


@dataclass(frozen=True)
class LoadResult:
    """Counts of one load."""

    run_no: int
    records: int
    rows: dict[str, int]
    skipped: bool = False


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("email_key", F.lower(F.trim("email")))


def prepare(records: DataFrame) -> DataFrame:
    """Trimmed records with the comparison key of their e-mail address.

    ``feed`` and ``pos`` order the records: the first of a key wins.
    """
    return (
        _keyed(trim_all(records.drop("journalist_id", "article_id")))  # given by the load
        .where(F.col("email_key") != "")
        .withColumn("article_title", F.coalesce("article_title", F.lit("")))
    )


def upsert_journalists(load: Load, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert unseen contacts; returns (email_key, journalist_id) of the whole
    batch and the inserted rows."""
    contacts = first_per_key(records, ["email_key"], ORDER)
    stored = _keyed(load.matching("journalist", records, ["email_key"]))
    flagged = stage(
        with_existence(
            contacts.select("email_key", *JOURNALIST_COLUMNS), stored, ["email_key"], "journalist_id"
        ),
        "contacts",
    )
    existing, unseen = split_on(flagged, F.col("is_exist"))
    numbered = dense_numbers(
        unseen.drop("journalist_id", "is_exist"), ["email_key"], "journalist_id",
        load.highest("journalist"),
    )
    load.add("journalist", numbered, ["journalist_id", *JOURNALIST_COLUMNS])
    inserted = _keyed(load.added("journalist"))
    ids = merge_rows(
        existing.select("email_key", "journalist_id"), inserted.select("email_key", "journalist_id")
    )
    return ids, inserted.drop("email_key")


def load_articles(load: Load, records: DataFrame, journalist_ids: DataFrame) -> DataFrame:
    """Insert the articles that are not stored; returns them with their new ids
    and the topic of their record."""
    attached = first_per_key(
        records.join(journalist_ids, "email_key").select(*ARTICLE_COLUMNS, "sub_beat_topic", *ORDER),
        ARTICLE_KEY,
        ORDER,
    )
    attached = stage(attached, "articles")
    stored = load.matching("article", attached, ARTICLE_KEY)
    fresh = stage(not_stored(attached, stored, ARTICLE_KEY), "new-articles")
    numbered = dense_numbers(fresh, ARTICLE_KEY, "article_id", load.highest("article"))
    load.add("article", numbered, ["article_id", *ARTICLE_COLUMNS])
    # the written rows, so that the bridge does not number them again
    return load.added("article").join(fresh.select(*ARTICLE_KEY, "sub_beat_topic", *ORDER), ARTICLE_KEY)


def upsert_topics(load: Load, records: DataFrame) -> DataFrame:
    """Insert unseen topics; returns (sub_beat_topic, sub_beat_id) of the batch.

    A topic is one row whatever its beats; the lowest beat id stays with it.
    """
    topics = one_row_per_topic(
        with_text(records, "sub_beat_topic").select("sub_beat_topic", "beat_id")
    )
    topics = stage(topics, "topics")
    stored = load.matching("sub_beat", topics, ["sub_beat_topic"])
    flagged = stage(with_existence(topics, stored, ["sub_beat_topic"], "sub_beat_id"), "topics")
    existing, unseen = split_on(flagged, F.col("is_exist"))
    numbered = dense_numbers(
        unseen.select("sub_beat_topic", "beat_id"), ["sub_beat_topic"], "sub_beat_id",
        load.highest("sub_beat"),
    )
    load.add("sub_beat", numbered)
    columns = ["sub_beat_topic", "sub_beat_id"]
    return merge_rows(existing.select(*columns), load.added("sub_beat").select(*columns))


def load_bridge(
    load: Load, articles: DataFrame, topics: DataFrame, records: DataFrame | None = None
) -> int:
    """One bridge row per new article, or per topic of its ``records``.

    Article ids of a load are dense already, so with one row per article the
    bridge ids follow from them without another sort.
    """
    default_topic = load.store.spark.range(1).select(F.lit(DEFAULT_TOPIC).alias("sub_beat_topic"))
    # topics of this load included
    default_id = default_member_id(load.matching("sub_beat", default_topic, ["sub_beat_topic"]), DEFAULT_TOPIC)
    if records is not None:
        listed = records.select(*ORDER, "sub_beat_topic").distinct()
        pairs = articles.select("article_id", *ORDER).join(listed, ORDER).drop(*ORDER)
        rows = topic_ids(pairs, topics, default_id).select("article_id", "sub_beat_id").distinct()
        return load.add(
            "article_subbeat",
            dense_numbers(rows, ["article_id", "sub_beat_id"], "article_subbeats_id",
                          load.highest("article_subbeat")),
        )
    rows = topic_ids(articles.select("article_id", "sub_beat_topic"), topics, default_id)
    shift = load.highest("article_subbeat") - load.before.get("article", 0)
    return load.add(
        "article_subbeat",
        rows.select(
            (F.col("article_id") + F.lit(shift)).alias("article_subbeats_id"),
            "article_id",
            "sub_beat_id",
        ),
    )


def load_records(
    store: StarStore,
    records: DataFrame,
    *,
    one_per_contact: bool = True,
    topics: str = "last",
    rejects: DataFrame | None = None,
    source: str = "batch",
    source_batch: int | None = None,
    log_root: str | None = None,
    now: dt.datetime | None = None,
) -> LoadResult:
    """Load one batch; all tables switch together at the end.

    A later step runs only when the one before it gave rows. A source batch
    that was committed before is skipped, so a replay changes nothing.

    ``topics="all"`` takes records with one row per topic of an item (equal
    ``feed`` and ``pos``) and writes one bridge row per topic.

    ``rejects`` (feed, reason, landed) are stored with the number of the run and
    counted in its log row.
    """
    load = store.begin()
    _finish_log(load, (now or dt.datetime.now(dt.timezone.utc)).date())
    if load.done_before(source, source_batch):
        return LoadResult(load.manifest["version"], 0, {}, skipped=True)
    spark = store.spark
    started = now or dt.datetime.now(dt.timezone.utc)
    with scope(spark):
        heads, listed, all_topics = prepare(records), None, 0
        if topics == "all":
            listed, all_topics = stage_counted(heads, "topics")
            heads = first_per_key(listed, ORDER, ["sub_beat_topic"])
        if one_per_contact:
            heads = first_per_key(heads, ["email_key"], ORDER)
        batch, count = stage_counted(heads, "batch")
        load.at_most = max(count, all_topics, 1)
        if listed is not None:
            listed = listed.join(batch.select(*ORDER), ORDER, "left_semi")
        if count:
            ids, inserted = upsert_journalists(load, batch)
            articles = load_articles(load, batch, ids)
            if load.rows["article"]:
                found = upsert_topics(load, batch if listed is None else listed)
                load_bridge(load, articles, found, listed)
        if rejects is not None:
            load.add("feed_reject", rejects.withColumn("run_no", F.lit(load.version).cast("bigint")))
        _log_run(load, source, source_batch, started, now, count)
        logged = log_root and load.rows.get("journalist")
        # only people who are stored are logged: the commit names the log, and a
        # load that ends before it is written leaves it to the next one
        load.manifest["log"] = {"root": log_root, "day": started.date().isoformat(), "version": load.version} if logged else None
        load.commit(source, source_batch)
        if logged:
            write_log(inserted, log_root, started.date(), load.version)
        if log_root:
            drop_old_logs(spark, log_root, started.date())
    return LoadResult(load.version, count, dict(load.rows))


def _finish_log(load: Load, today: dt.date) -> None:
    """Write the log of the last commit if that load did not come to it."""
    pending = load.manifest.get("log")
    if not pending or dt.date.fromisoformat(pending["day"]) < today - dt.timedelta(days=KEEP_DAYS):
        return
    day = dt.date.fromisoformat(pending["day"])
    if not log_written(load.store.spark, pending["root"], day, pending["version"]):
        write_log(load.store.rows_of_version("journalist", pending["version"], load.manifest), pending["root"], day, pending["version"])


def _log_run(load: Load, source, source_batch, started, now, count: int) -> None:
    """One run-log row: counts only, never addresses."""
    ended = now or dt.datetime.now(dt.timezone.utc)
    message = (
        f"Run {load.version} completed on {ended:%d/%m/%Y %H:%M:%S}; {count} records loaded."
    )
    tables = ("journalist", "article", "sub_beat", "article_subbeat")
    values = [load.version, source, source_batch, started, ended, count,
              *(load.rows.get(t, 0) for t in tables), message, load.rows.get("feed_reject", 0)]
    names = load.store.tables["run_log"].fieldNames()
    row = load.store.spark.range(1).select(*(F.lit(x).alias(n) for n, x in zip(names, values)))
    load.add("run_log", row)
