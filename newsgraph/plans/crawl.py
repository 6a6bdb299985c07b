"""Feed items and landed pages to crawl records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.operators.contacts import ARTICLE_PICKS, BIO_PICKS, PROFILE_PICKS, contact_entries, pages_of
from newsgraph.operators.dedupe import first_per_email
from newsgraph.operators.elements import may_match, pick_elements
from newsgraph.operators.lookups import beat_ids
from newsgraph.operators.profile import contact_rows
from newsgraph.operators.topics import BEAT_PICKS, attach_topics, story_topics, valid_topics
from newsgraph.sources.feeds import crawl_records
from newsgraph.sources.picked import PickedPages
from newsgraph.sources.tables import LANDED
from newsgraph.staging import stage

ALL_PICKS = [*ARTICLE_PICKS, *BIO_PICKS, *PROFILE_PICKS, *BEAT_PICKS]


def pick_pages(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Picked elements of landed pages, for a batch or for a stream of pages.

    Pages that show none of the wanted elements never reach Python.
    ``partitions`` deals them anew, for a table in few large files. Where pages
    have ``landed_at``, every version is kept, also one without elements: it
    hides the older ones.
    """
    candidate = may_match(ALL_PICKS)
    if LANDED not in pages.columns:
        return pick_elements(pages.where(candidate), ALL_PICKS, partitions=partitions).where(F.size("picks") > 0)
    # the texts of pages without elements stay in the JVM
    return pick_elements(pages.withColumn("html", F.when(candidate, F.col("html"))), ALL_PICKS,
                         partitions=partitions, keep=[LANDED])


def picked_pages(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``pick_pages`` as a written table: one scan of the texts.

    Article, author, profile and beat lookups all join this small table. A
    stream keeps it up to date as pages land (``streaming.cycle.pick_stream``).
    """
    return stage(pick_pages(pages, partitions), "picked")


def crawl(
    items: DataFrame,
    picked: DataFrame | PickedPages,
    beats: DataFrame,
    gazetteer: DataFrame,
    *,
    model=None,
    one_per_contact: bool = True,
    topics: str = "last",
) -> DataFrame:
    """Records ready to load: contacts, article, beat id and story topic.

    ``picked`` is the table of picked elements, not the pages themselves, so a
    cycle over a few new items does not read page texts again.
    ``one_per_contact`` keeps the first item of every e-mail address.
    """
    items = stage(items, "items")
    entries = contact_entries(items, picked, gazetteer, model)
    records = crawl_records(items, contact_rows(entries))
    if one_per_contact:
        records = first_per_email(records, ["feed", "pos"])
    beat_pages = pages_of(picked, items.select(F.col("beat_link").alias("url")))
    stories = valid_topics(story_topics(beat_pages), gazetteer, model)
    return attach_topics(beat_ids(records, beats), stories, topics)
