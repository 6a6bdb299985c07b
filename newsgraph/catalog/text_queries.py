"""String, date and contact function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.catalog import views as v
from newsgraph.catalog.registry import query
from newsgraph.functions import dates, text
from newsgraph.operators.entity import last_entity_word
from newsgraph.operators.topics import last_topic

_EMAIL = text.EMAIL_PATTERN


@query(
    "str_1_email",
    f"""SELECT doc_id, coalesce(list_extract(regexp_extract_all(text, '{_EMAIL}'), -1), '') AS email
FROM documents""",
)
def email(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", text.last_email(F.col("text")).alias("email")
    )


def _sql_clean(column: str) -> str:
    pairs = [*text.UNESCAPED, *((m, "") for m in text.REMOVED)]
    for old, new in pairs:
        old = {"\r": "chr(13)", "\n": "chr(10)"}.get(old) or "'" + old.replace("'", "''") + "'"
        column = f"replace({column}, {old}, '{new.replace(chr(39), chr(39) * 2)}')"
    return column


SQL_CLEAN = _sql_clean


@query("str_2_html_clean", f"SELECT page_id, {_sql_clean('html')} AS cleaned FROM pages")
def html_clean(spark, sf):
    return v.table(spark, sf, "pages").select(
        "page_id", text.clean_html(F.col("html")).alias("cleaned")
    )


@query(
    "str_3_xml_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""",
)
def xml_escape(spark, sf):
    return v.table(spark, sf, "pages").select(
        "page_id", text.escape_xml(F.col("html")).alias("escaped")
    )


@query(
    "str_4_name_before_comma",
    "SELECT doc_id, split_part(text, ',', 1) AS name FROM documents",
)
def before_comma(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", text.name_before_comma(F.col("text")).alias("name")
    )


@query(
    "str_5_location_words",
    rf"""WITH {v.GAZETTEER},
words AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_''-]*') AS l FROM documents)),
kept AS (SELECT doc_id, i, l[i + 1] AS word FROM words
  WHERE l[i + 1] IN (SELECT entity FROM gazetteer))
SELECT doc_id, arg_max(word, i) AS word FROM kept GROUP BY doc_id""",
)
def location_words(spark, sf):
    """Last gazetteer word of every document, read as a location text."""
    docs = v.table(spark, sf, "documents").select(
        "doc_id", text.location_words(F.col("text")).alias("words")
    )
    return last_entity_word(docs, "doc_id", "words", v.gazetteer(spark, sf))


@query(
    "str_6_state_country",
    """SELECT doc_id, list_extract(string_split(text, ','), 1) AS state,
  list_extract(string_split(text, ','), 2) AS country FROM documents""",
)
def state_country(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.state_of(F.col("text")).alias("state"),
        text.country_of(F.col("text")).alias("country"),
    )


@query(
    "str_7_cluster_id",
    "SELECT page_id, list_extract(string_split(url, '='), 2) AS cid FROM pages",
)
def cluster_id(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.cluster_id(F.col("url")).alias("cid"))


_HREFS = r"""hrefs AS (
  SELECT page_id, l, unnest(range(len(l))) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)),
links AS (
  SELECT page_id, i AS pos, CASE (page_id + i) % 5
    WHEN 0 THEN 'http://twitter.com' || l[i + 1] WHEN 1 THEN 'https://www.linkedin.com' || l[i + 1]
    WHEN 2 THEN 'mailto:desk@example.com' WHEN 3 THEN 'http://news.example.com' || l[i + 1]
    ELSE l[i + 1] END AS href FROM hrefs)"""


@query(
    "str_8_link_class",
    f"""WITH {_HREFS}
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN contains(href, 'twitter.com') THEN 'twitter'
  WHEN contains(href, 'linkedin.com') THEN 'linkedin'
  WHEN contains(href, 'mailto:') THEN 'email' END AS kind,
  starts_with(href, 'http://') AS absolute FROM links""",
)
def link_class(spark, sf):
    """Navigation links of all pages, with a host put in front of most."""
    links = v.table(spark, sf, "pages").select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "path"),
    )
    hosts = F.array(*(F.lit(h) for h in ["http://twitter.com", "https://www.linkedin.com",
                                         "mailto:desk@example.com", "http://news.example.com", ""]))
    kind = (F.col("page_id") + F.col("pos")) % 5
    href = F.concat(
        F.element_at(hosts, (kind + 1).cast("int")), F.when(kind != 2, F.col("path")).otherwise("")
    )
    return links.select(
        "page_id", "pos",
        text.link_class(href).alias("kind"),
        text.is_absolute_link(href).alias("absolute"),
    )


@query(
    "str_9_tag_codec",
    f"""WITH {v.PROFILE_ENTRIES}
SELECT item_id, pos, tag || ':' || value AS entry, tag, value FROM profile_entries""",
)
def tag_codec(spark, sf):
    coded = v.profile_entries(spark, sf).select(
        "item_id", "pos", text.entry_text(F.col("tag"), F.col("value")).alias("entry")
    )
    back = text.entry_of(F.col("entry"))
    return coded.select("*", back["tag"].alias("tag"), back["value"].alias("value"))


@query(
    "dat_1_exact_timestamp",
    """WITH t AS (SELECT event_id, CASE event_id % 3
    WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d')
    ELSE event_type END AS txt FROM events)
SELECT event_id, CASE WHEN length(txt) = 19
  THEN strftime(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END AS ts FROM t""",
)
def exact_timestamp(spark, sf):
    form = F.col("event_id") % 3
    txt = (
        F.when(form == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.col("event_type"))
    )
    return v.table(spark, sf, "events").select(
        "event_id", F.date_format(dates.exact_timestamp(txt), "yyyy-MM-dd HH:mm:ss").alias("ts")
    )


@query(
    "dat_2_date_labels",
    """SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS day,
  strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS clock FROM orders""",
)
def date_labels(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        dates.day_label(F.col("o_orderdate")).alias("day"),
        dates.clock_label(F.col("o_orderdate")).alias("clock"),
    )


@query(
    "agg_2_last_topic",
    f"WITH {v.NAV_TOPICS} SELECT page_id, arg_max(topic, pos) AS topic FROM nav_topics GROUP BY page_id",
)
def last_nav_topic(spark, sf):
    return last_topic(v.nav_topics(spark, sf), "page_id")
