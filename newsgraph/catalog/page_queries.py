"""Page extraction and entity gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.catalog import site as st, views as v
from newsgraph.catalog.load_queries import NOW, new_store
from newsgraph.catalog.registry import query
from newsgraph.operators.contacts import (
    article_facts,
    bio_entries,
    bio_links,
    byline_entries,
    contact_entries,
    newest_picks,
    page_entries,
    profile_facts,
)
from newsgraph.operators.elements import Pick, first_of, pick_elements
from newsgraph.operators.entity import with_gate
from newsgraph.operators.profile import contact_rows
from newsgraph.operators.topics import story_topics, valid_topics
from newsgraph.plans.crawl import crawl, picked_pages
from newsgraph.plans.load import load_records


@query(
    "ext_1_element_pick",
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
  regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) AS first_link FROM pages""",
)
def element_pick(spark, sf):
    picks = [Pick("title", "title"), Pick("heading", "h1"), Pick("nav", "nav"),
             Pick("nav_link", "a", inside="nav")]
    picked = pick_elements(v.table(spark, sf, "pages"), picks, key="page_id")
    return picked.select(
        "page_id",
        first_of("title")["text"].alias("title"),
        first_of("heading")["text"].alias("heading"),
        first_of("nav_link", first_of("nav")["pos"])["href"].alias("first_link"),
    )


def _facts(spark, sf):
    """Article facts of the site items (the pages are picked once)."""
    picked = picked_pages(st.pages(spark, sf), spark.sparkContext.defaultParallelism)
    picked = newest_picks(picked)
    links = st.items(spark, sf).select("item_id", F.col("link").alias("url"))
    return article_facts(links.join(picked, "url"), "item_id"), picked


@query(
    "ext_2_byline",
    f"WITH {st.SITE} SELECT k AS item_id, 'name' AS tag, writer AS value FROM site WHERE known AND shape < 7",
)
def byline(spark, sf):
    facts, _ = _facts(spark, sf)
    return byline_entries(facts, st.names(spark, sf)).select("item_id", "tag", "value")


@query(
    "ext_3_author_contacts",
    f"""WITH {st.SITE}
SELECT k AS item_id, 'email' AS tag, desk_email AS value FROM site WHERE shape IN (0, 3)
UNION ALL SELECT k, 'email', '' FROM site WHERE shape = 4
UNION ALL SELECT k, 'Media link', tw_url FROM site WHERE shape IN (0, 2, 4, 5)
UNION ALL SELECT k, 'Media link', '' FROM site WHERE shape = 3
UNION ALL SELECT k, 'LinkedIn', li_url FROM site WHERE shape IN (0, 2)
UNION ALL SELECT k, 'LinkedIn', '' FROM site WHERE shape IN (3, 4, 5)
UNION ALL SELECT k, 'website', by_url FROM site WHERE shape IN (1, 5)""",
)
def author_contacts(spark, sf):
    facts, _ = _facts(spark, sf)
    return page_entries(facts).where("tag <> '@profile'").select("item_id", "tag", "value")


@query(
    "ext_4_bio_links",
    f"""WITH {st.SITE}
SELECT k AS item_id, 'Media link' AS tag, tw_url AS value FROM site WHERE shape IN (1, 5)
UNION ALL SELECT k, 'LinkedIn', li_url FROM site WHERE shape IN (1, 5)
UNION ALL SELECT k, 'email', own_email FROM site WHERE shape IN (1, 5)""",
)
def bio_page_links(spark, sf):
    facts, picked = _facts(spark, sf)
    rows = bio_entries(facts, bio_links(picked))
    return rows.where("tag <> '@profile'").select("item_id", "tag", "value")


@query(
    "ext_5_profile_card",
    f"""WITH {st.SITE}
SELECT tw_url AS url, bio, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE own_email END AS email,
  CASE WHEN known THEN n_name END AS place FROM site""",
)
def profile_card(spark, sf):
    picked = newest_picks(picked_pages(st.pages(spark, sf), spark.sparkContext.defaultParallelism))
    return profile_facts(picked, st.names(spark, sf))


@query(
    "ext_6_story_topics",
    f"""WITH {st.SITE}
SELECT beat_url AS beat_link, k AS cid, c_mktsegment AS topic FROM site
UNION ALL SELECT beat_url, k, n_name || ' news' FROM site WHERE NOT known
UNION ALL SELECT beat_url, '9' || k, 'Wrong one' FROM site""",
)
def topics_of_stories(spark, sf):
    picked = newest_picks(picked_pages(st.pages(spark, sf), spark.sparkContext.defaultParallelism))
    topics = story_topics(picked)
    return valid_topics(topics, st.names(spark, sf)).select("beat_link", "cid", "topic")


@query(
    "ext_6_nav_topics",
    f"""WITH {v.GAZETTEER}, {v.NAV_TOPICS},
words AS (SELECT topic, unnest(regexp_extract_all(topic, '[A-Za-z0-9_''-]+')) AS w FROM nav_topics),
named AS (SELECT DISTINCT topic FROM words WHERE w IN (SELECT entity FROM gazetteer))
SELECT page_id, pos, topic FROM nav_topics WHERE topic NOT IN (SELECT topic FROM named)""",
)
def nav_topics_kept(spark, sf):
    return valid_topics(v.nav_topics(spark, sf), v.gazetteer(spark, sf))


@query(
    "ent_1_entity_gate",
    rf"""WITH {v.LONG_NAMES},
texts AS (SELECT doc_id AS id, text FROM documents
  UNION ALL SELECT -1 - event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events),
lists AS (SELECT id, regexp_extract_all(text, '[A-Za-z0-9_''-]+') AS l FROM texts),
words AS (
  SELECT id, unnest(l) AS w FROM lists
  UNION ALL SELECT id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM lists
  UNION ALL SELECT id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) FROM lists)
SELECT id, id >= 0 AND id NOT IN (SELECT id FROM words WHERE w IN (SELECT entity FROM gazetteer))
  AS is_topic FROM texts""",
)
def entity_gate(spark, sf):
    """Whole documents, and time stamps of events as texts that never pass."""
    texts = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(
        v.table(spark, sf, "events").select(
            (-1 - F.col("event_id")).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text")
        )
    )
    gated = with_gate(texts, "text", v.long_names(spark, sf), longest=3, key="id")
    return gated.select("id", "is_topic")


_CONTACT_COLUMNS = "email, name, state, media_link, linkedin_url, website, about_info"


@query(
    "find_contacts",
    f"""WITH {st.FOUND}
SELECT k AS item_id, CAST(NULL AS VARCHAR) AS country, {_CONTACT_COLUMNS} FROM found WHERE email IS NOT NULL""",
)
def find_contacts(spark, sf):
    """Pages to contact rows: byline, icons, author page, profile page, gate,
    eligibility, distinct profile and pivot in one plan."""
    picked = picked_pages(st.pages(spark, sf), spark.sparkContext.defaultParallelism)
    entries = contact_entries(st.items(spark, sf), picked, st.names(spark, sf))
    return contact_rows(entries)


@query(
    "crawl_to_star",
    f"""WITH {st.FOUND}, {st.SEGMENT_BEATS},
loaded AS (SELECT f.*, coalesce(b.beat_id, 0) AS beat_id,
    CASE WHEN c_custkey % 10 <> 0 THEN last_topic END AS topic
  FROM found f LEFT JOIN segment_beats b ON b.beat_topic = f.c_mktsegment WHERE email IS NOT NULL),
topics AS (SELECT topic, min(beat_id) AS beat_id FROM loaded WHERE topic IS NOT NULL GROUP BY 1)
SELECT l.email, l.name, 'The Daily ' || c_mktsegment AS association,
  'Story "' || k || '" - The Daily ' || c_mktsegment AS article_title, l.link AS article_link,
  l.topic AS sub_beat_topic, t.beat_id
FROM loaded l LEFT JOIN topics t ON t.topic = l.topic""",
)
def crawl_to_star(spark, sf):
    """Feed items and landed pages to the stored star schema, read back."""
    picked = picked_pages(st.pages(spark, sf), spark.sparkContext.defaultParallelism)
    records = crawl(
        st.items(spark, sf), picked, st.segment_beats(spark, sf), st.names(spark, sf)
    )
    store = new_store(spark)
    load_records(store, records, now=NOW)
    people = store.read("journalist").select("journalist_id", "email", "name", "association")
    return (
        store.read("article")
        .join(people, "journalist_id")
        .join(store.read("article_subbeat"), "article_id")
        .join(store.read("sub_beat"), "sub_beat_id", "left")
        .select("email", "name", "association", "article_title", "article_link", "sub_beat_topic", "beat_id")
    )
