"""Story topics from beat pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions.text import clean_html, is_numeric, trim_ws
from newsgraph.operators.elements import Pick
from newsgraph.operators.entity import with_gate

# The elements of a story block; the trailing blank is part of the class.
BEAT_PICKS = [
    Pick("story", "div", "class", "story anchorman-blended-story esc esc-has-thumbnail "),
    Pick("topics", "div", "class", "esc-topics-wrapper", inside="story"),
    Pick("topic", "div", "class", "esc-topic-wrapper", child_of="topics"),
]


def story_topics(picked: DataFrame) -> DataFrame:
    """(beat_link, cid, pos, topic): cleaned topic texts of every story block.

    Topics are read from the block of their own story. Of several blocks with
    one cluster id on a page the first counts, of several topic lists in a block
    too. Blocks, lists and topics meet by equi-joins on page and position, so the
    work is in proportion to the elements of a page and not to their square.
    """
    elements = picked.select(F.col("url").alias("beat_link"), F.inline("picks"))
    of = lambda name: elements.where(F.col("pick") == name)
    stories = of("story").where(F.col("cid").isNotNull()).groupBy("beat_link", "cid").agg(F.min("pos").alias("story"))
    lists = of("topics").groupBy("beat_link", F.col("scope").alias("story")).agg(F.min("pos").alias("list"))
    topics = of("topic").select("beat_link", F.col("scope").alias("list"), "pos", "text")
    return stories.join(lists, ["beat_link", "story"]).join(topics, ["beat_link", "list"]).select(
        "beat_link", "cid", "pos", clean_html(F.col("text")).alias("topic"))


def valid_topics(topics: DataFrame, gazetteer: DataFrame | None, model=None) -> DataFrame:
    """Topics that name no entity and are no timestamp, trimmed."""
    return (
        with_gate(topics, "topic", gazetteer, model)
        .where(F.col("is_topic"))
        .withColumn("topic", trim_ws(F.col("topic")))
        .drop("is_topic")
    )


def last_listed(topics: Column) -> Column:
    """The last topic of a list that is at hand in the row; null when empty."""
    return F.try_element_at(topics, F.lit(-1))


def last_topic(topics: DataFrame, *keys: str) -> DataFrame:
    """One topic per key: the last one wins."""
    return topics.groupBy(*keys).agg(F.max_by("topic", "pos").alias("topic"))


def attach_topics(work: DataFrame, topics: DataFrame, which: str = "last") -> DataFrame:
    """Add ``sub_beat_topic`` by (beat_link, cid); null when there is none.

    ``which="all"`` keeps one row per topic instead of the last topic only.
    """
    keys = ["beat_link", "cid"]
    chosen = last_topic(topics, *keys) if which == "last" else topics.select(*keys, "topic").distinct()
    chosen = chosen.where(is_numeric(F.col("cid"))).withColumnRenamed("topic", "sub_beat_topic")
    return work.join(chosen, keys, "left")
