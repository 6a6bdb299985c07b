"""Fixed schemas of the landed inputs and of the stored star schema."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


GUID = _struct(_VALUE=StringType(), _isPermaLink=StringType())

FEED_ITEM = _struct(
    title=StringType(),
    link=StringType(),
    category=StringType(),
    pubDate=StringType(),
    guid=GUID,
)

FEED_CHANNEL = _struct(title=StringType(), link=StringType(), item=ArrayType(FEED_ITEM))

#: ``landed_at`` tells the versions of a page apart; without it a page lands once
PAGES = _struct(url=StringType(), html=StringType(), landed_at=TimestampType())

BEAT = _struct(beat_id=IntegerType(), beat_topic=StringType())

JOURNALIST = _struct(
    journalist_id=LongType(),
    name=StringType(),
    designation=StringType(),
    state=StringType(),
    country=StringType(),
    email=StringType(),
    media_link=StringType(),
    linkedin_url=StringType(),
    website=StringType(),
    association=StringType(),
    about_info=StringType(),
)

ARTICLE = _struct(
    article_id=LongType(),
    publication_date=TimestampType(),
    article_title=StringType(),
    article_link=StringType(),
    journalist_id=LongType(),
)

SUB_BEAT = _struct(
    sub_beat_id=LongType(), sub_beat_topic=StringType(), beat_id=IntegerType()
)

ARTICLE_SUBBEAT = _struct(
    article_subbeats_id=LongType(), article_id=LongType(), sub_beat_id=LongType()
)

RUN_LOG = _struct(
    run_no=LongType(),
    source=StringType(),
    source_batch=LongType(),
    started_at=TimestampType(),
    ended_at=TimestampType(),
    records=LongType(),
    new_journalists=LongType(),
    new_articles=LongType(),
    new_sub_beats=LongType(),
    new_bridges=LongType(),
    message=StringType(),
    rejects=LongType(),
)

FEED_REJECT = _struct(run_no=LongType(), feed=StringType(), reason=StringType(), landed=StringType())

STAR_TABLES: dict[str, StructType] = {
    "journalist": JOURNALIST,
    "article": ARTICLE,
    "sub_beat": SUB_BEAT,
    "article_subbeat": ARTICLE_SUBBEAT,
    "run_log": RUN_LOG,
    "feed_reject": FEED_REJECT,
}

#: surrogate id of each stored table
ID_COLUMN = {
    "journalist": "journalist_id",
    "article": "article_id",
    "sub_beat": "sub_beat_id",
    "article_subbeat": "article_subbeats_id",
    "run_log": "run_no",
    "feed_reject": "run_no",
}

#: key by which a stored table is looked up, as expressions over its columns
KEY_COLUMNS = {
    "journalist": ("lower(trim(email))",),
    "article": ("article_title", "journalist_id"),
    "sub_beat": ("sub_beat_topic",),
}

GAZETTEER = _struct(entity=StringType(), type=StringType())
