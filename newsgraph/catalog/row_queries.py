"""Projection, cast, filter, profile and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.catalog import views as v
from newsgraph.catalog.registry import query
from newsgraph.catalog.text_queries import SQL_CLEAN
from newsgraph.functions import dates, rows, text
from newsgraph.operators.dedupe import distinct_pairs, first_per_email
from newsgraph.operators.lookups import merge_rows
from newsgraph.operators.profile import (
    append_entries,
    distinct_profile,
    eligible,
    entries_minus,
    pivot_profile,
)
from newsgraph.sources.feeds import crawl_records


@query(
    "prj_2_title_split",
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS head,
  trim(list_extract(string_split(o_orderpriority, '-'), -1)) AS publisher FROM orders""",
)
def title_split(spark, sf):
    title = F.col("o_orderpriority")
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        text.title_head(title).alias("head"),
        F.trim(text.publisher_of(title)).alias("publisher"),
    )


def _page_contacts(spark, sf):
    key = F.col("page_id").cast("string")
    null = F.lit(None).cast("string")
    return v.table(spark, sf, "pages").select(
        key.alias("item_id"),
        F.concat(F.lit("p"), key, F.lit("@example.com")).alias("email"),
        null.alias("name"), null.alias("state"), null.alias("country"),
        null.alias("media_link"), null.alias("linkedin_url"),
        F.col("url").alias("website"),
        text.clean_html(F.col("url")).alias("about_info"),
    )


def _page_records(spark, sf):
    items = v.page_items(spark, sf).withColumn("beat_link", F.col("link"))
    return crawl_records(items, _page_contacts(spark, sf))


@query(
    "prj_3_crawl_record",
    f"""WITH {v.PAGE_ITEMS}
SELECT 0 AS journalist_id, CAST(NULL AS VARCHAR) AS name, category AS beat,
  'p' || item_id || '@example.com' AS email, link AS website,
  list_extract(string_split(title, '-'), -1) AS association, {SQL_CLEAN('link')} AS about_info,
  CAST(NULL AS INTEGER) AS article_id, strftime(pub_ts, '%Y-%m-%d %H:%M:%S') AS publication_date,
  {SQL_CLEAN('title')} AS article_title, link AS article_link, pos,
  list_extract(string_split(guid_text, '='), 2) AS cid
FROM page_items""",
)
def crawl_record(spark, sf):
    return _page_records(spark, sf).select(
        "journalist_id", "name", "beat", "email", "website", "association", "about_info",
        "article_id", F.date_format("publication_date", "yyyy-MM-dd HH:mm:ss").alias("publication_date"),
        "article_title", "article_link", "pos", "cid",
    )


@query(
    "prj_4_project_away",
    f"""WITH {v.RECORDS}
SELECT 0 AS journalist_id, name, state, email, association, sub_beat_topic, beat_id, pos
FROM order_records""",
)
def project_away(spark, sf):
    records = v.order_records(spark, sf, v.table(spark, sf, "orders")).drop(
        "designation", "country", "media_link", "linkedin_url", "website", "about_info", "feed"
    )
    return rows.journalist_part(records)


@query(
    "prj_5_project_to",
    """SELECT CAST(NULL AS INTEGER) AS article_subbeats_id, l_orderkey AS article_id,
  l_partkey AS sub_beat_id FROM lineitem""",
)
def project_to(spark, sf):
    work = v.table(spark, sf, "lineitem").withColumnsRenamed(
        {"l_orderkey": "article_id", "l_partkey": "sub_beat_id"}
    )
    return rows.bridge_part(work)


@query(
    "prj_6_trim_all",
    r"""SELECT doc_id, n_chars, regexp_replace(regexp_replace(chr(9) || ' ' || text || ' ' || chr(10),
  '^\s+', ''), '\s+$', '') AS text, lang, source FROM documents""",
)
def trim_all(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))
    return rows.trim_all(v.table(spark, sf, "documents").withColumn("text", padded))


@query(
    "prj_7_typed_columns",
    """SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS INTEGER) AS priority,
  try_cast(o_orderstatus AS INTEGER) AS status_no,
  CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS flag,
  CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS published
FROM orders""",
)
def typed_columns(spark, sf):
    key = F.col("o_orderkey")
    flag = F.when(key % 3 == 0, "true").when(key % 3 == 1, "False").otherwise("maybe")
    rfc = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    published = F.when(key % 4 != 0, rfc).otherwise(F.col("o_orderpriority"))
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        dates.to_int(F.left("o_orderpriority", F.lit(1))).alias("priority"),
        dates.to_int(F.col("o_orderstatus")).alias("status_no"),
        dates.to_bool(flag).alias("flag"),
        F.date_format(dates.feed_timestamp(published), "yyyy-MM-dd HH:mm:ss").alias("published"),
    )


_TOPIC_PARTS = """t AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ''
  WHEN p_size % 5 = 1 THEN NULL ELSE p_brand END AS topic FROM part)"""


@query(
    "flt_1_non_empty",
    f"""WITH {_TOPIC_PARTS}
SELECT 'with_text' AS rule, p_partkey, topic FROM t WHERE topic <> ''
UNION ALL SELECT 'without_empty', p_partkey, topic FROM t WHERE topic IS NULL OR topic <> ''""",
)
def non_empty(spark, sf):
    topic = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 != 1, F.col("p_brand"))
    topics = v.table(spark, sf, "part").select("p_partkey", topic.alias("topic"))
    marked = lambda rule, df: df.select(F.lit(rule).alias("rule"), "p_partkey", "topic")
    return marked("with_text", rows.with_text(topics, "topic")).unionByName(
        marked("without_empty", rows.without_empty(topics, "topic"))
    )


@query(
    "flt_2_flag_split",
    """SELECT event_id, CASE WHEN value > 20 THEN 'existing' ELSE 'new' END AS part FROM events""",
)
def flag_split(spark, sf):
    existing, new = rows.split_on(v.table(spark, sf, "events"), F.col("value") > 20)
    return existing.select("event_id", F.lit("existing").alias("part")).unionByName(
        new.select("event_id", F.lit("new").alias("part"))
    )


_DOC_ENTRIES = f"""doc_entries AS (
  SELECT doc_id AS item_id, 1 AS pos, 'name' AS tag, source AS value FROM documents
  UNION ALL SELECT doc_id, 2, 'email',
    coalesce(list_extract(regexp_extract_all(text, '{text.EMAIL_PATTERN}'), -1), '') FROM documents
  UNION ALL SELECT doc_id, 3, 'email', source || '@example.com' FROM documents)"""


def _doc_entries(spark, sf):
    entry = lambda pos, tag, value: F.struct(
        F.lit(pos).alias("pos"), F.lit(tag).alias("tag"), value.alias("value")
    )
    return v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.inline(
            F.array(
                entry(1, "name", F.col("source")),
                entry(2, "email", text.last_email(F.col("text"))),
                entry(3, "email", F.concat("source", F.lit("@example.com"))),
            )
        ),
    )


@query(
    "flt_3_contact_eligibility",
    f"""WITH {_DOC_ENTRIES}
SELECT item_id, pos, tag, value FROM doc_entries WHERE item_id IN (
  SELECT item_id FROM doc_entries WHERE tag = 'email' GROUP BY item_id
  HAVING arg_min(value, pos) <> '')""",
)
def contact_eligibility(spark, sf):
    return eligible(_doc_entries(spark, sf))


_NUMBERS = """n AS (
  SELECT page_id, 'path' AS form, regexp_extract(url, '[a-z]/([^/?#]+)', 1) AS txt FROM pages
  UNION ALL SELECT page_id, 'comma', CAST(page_id AS VARCHAR) || ',000' FROM pages
  UNION ALL SELECT page_id, 'blank', ' ' || CAST(page_id AS VARCHAR) || ' ' FROM pages
  UNION ALL SELECT page_id, 'text', 'c' || CAST(page_id AS VARCHAR) FROM pages)"""


@query(
    "flt_4_numeric_id",
    f"""WITH {_NUMBERS} SELECT page_id, form, try_cast(replace(txt, ',', '') AS DOUBLE) IS NOT NULL
  AS numeric_id FROM n""",
)
def numeric_id(spark, sf):
    key = F.col("page_id").cast("string")
    forms = {
        "path": F.regexp_extract("url", "[a-z]/([^/?#]+)", 1),
        "comma": F.concat(key, F.lit(",000")),
        "blank": F.concat(F.lit(" "), key, F.lit(" ")),
        "text": F.concat(F.lit("c"), key),
    }
    entries = [F.struct(F.lit(f).alias("form"), t.alias("txt")) for f, t in forms.items()]
    return (
        v.table(spark, sf, "pages")
        .select("page_id", F.inline(F.array(*entries)))
        .select("page_id", "form", text.is_numeric(F.col("txt")).alias("numeric_id"))
    )


@query(
    "dedup_1_first_per_email",
    f"""WITH {v.PEOPLE}
SELECT email_key, o_orderkey FROM (
  SELECT lower(email) AS email_key, o_orderkey,
         row_number() OVER (PARTITION BY lower(email) ORDER BY o_orderkey) AS rn
  FROM incoming_orders JOIN contacts ON c_custkey = o_custkey)
WHERE rn = 1""",
)
def first_of_email(spark, sf):
    """First incoming order of every buyer; odd orders write the address in
    capitals with blanks around it."""
    _, incoming = v.orders_split(spark, sf)
    people = v.contacts(spark, sf).select(F.col("c_custkey").alias("o_custkey"), "email")
    odd = F.concat(F.lit(" "), F.upper("email"), F.lit(" "))
    mails = incoming.join(people, "o_custkey").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 1, odd).otherwise(F.col("email")).alias("email"),
    )
    return first_per_email(mails, ["o_orderkey"]).select(
        F.lower(F.trim("email")).alias("email_key"), "o_orderkey"
    )


@query(
    "dedup_2_distinct_pairs",
    """SELECT DISTINCT p_brand AS sub_beat_topic, p_type AS beat
FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def topic_pairs(spark, sf):
    lines = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    parts = v.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("sub_beat_topic"), F.col("p_type").alias("beat")
    )
    # only which parts occur matters, so the big side is a semi join
    return distinct_pairs(parts.join(lines, "p_partkey", "left_semi"), "sub_beat_topic", "beat")


_DISTINCT_PROFILE = """distinct_profile AS (
  SELECT item_id, -1 AS pos, 'email' AS tag, arg_min(value, pos) AS value
  FROM profile_entries WHERE tag = 'email' GROUP BY item_id
  UNION ALL SELECT item_id, min(pos), tag, value FROM profile_entries
  WHERE tag <> 'email' GROUP BY item_id, tag, value)"""


@query(
    "dedup_3_distinct_profile",
    f"WITH {v.PROFILE_ENTRIES}, {_DISTINCT_PROFILE} SELECT item_id, pos, tag, value FROM distinct_profile",
)
def profile_distinct(spark, sf):
    return distinct_profile(v.profile_entries(spark, sf))


@query(
    "agg_1_profile_pivot",
    f"""WITH {v.PROFILE_ENTRIES}, {_DISTINCT_PROFILE},
wide AS (SELECT item_id, arg_max(value, pos) FILTER (tag = 'email') AS email,
  arg_max(value, pos) FILTER (tag = 'Loc') AS loc, arg_max(value, pos) FILTER (tag = 'bio') AS bio
  FROM distinct_profile GROUP BY item_id)
SELECT item_id, email, CAST(NULL AS VARCHAR) AS name, split_part(loc, ',', 1) AS state,
  split_part(loc, ',', 2) AS country, CAST(NULL AS VARCHAR) AS media_link,
  CAST(NULL AS VARCHAR) AS linkedin_url, CAST(NULL AS VARCHAR) AS website,
  {SQL_CLEAN('bio')} AS about_info FROM wide""",
)
def profile_pivot(spark, sf):
    return pivot_profile(distinct_profile(v.profile_entries(spark, sf)))


@query(
    "set_1_merge_rows",
    """SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL SELECT p_partkey, NULL, p_brand FROM part""",
)
def merge_two(spark, sf):
    left = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return merge_rows(left, right)


@query(
    "set_3_list_difference",
    f"""WITH {v.PROFILE_ENTRIES}
SELECT item_id, tag, value FROM profile_entries
EXCEPT SELECT item_id, tag, value FROM profile_entries WHERE tag = 'email'""",
)
def list_difference(spark, sf):
    entries = v.profile_entries(spark, sf)
    return entries_minus(entries, entries.where("tag = 'email'"))


@query(
    "set_4_list_append",
    f"""WITH {v.PROFILE_ENTRIES}, {_DOC_ENTRIES}
SELECT item_id, pos, tag, value FROM profile_entries
UNION ALL SELECT item_id, pos, tag, value FROM doc_entries""",
)
def list_append(spark, sf):
    return append_entries(
        v.profile_entries(spark, sf),
        _doc_entries(spark, sf).withColumn("pos", F.col("pos").cast("bigint")),
    )
