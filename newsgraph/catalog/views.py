"""Pipeline inputs as views over the given tables, in Spark and in SQL.

Every Spark function here has its SQL text next to it; the SQL goes into a
``WITH`` clause of the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.operators.numbering import dense_numbers


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def latest(df: DataFrame, column: str):
    """Literal of the latest value of a time column, free of any time zone."""
    return F.lit(str(df.agg(F.max(column)).first()[0])).cast("timestamp_ntz")


# -- pages as feed items ------------------------------------------------------
NAV_LINK = r'<li><a href="[^"]*">([^<]*)</a></li>'
URL_PARTS = r"^https?://([^/]+)/([a-z]+)/([^?#/]+)"


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    """One item per landed page."""
    part = lambda i: F.regexp_extract("url", URL_PARTS, i)
    return table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("item_id"),
        part(1).alias("feed"),
        F.col("page_id").alias("pos"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        part(2).alias("category"),
        F.concat(F.lit("cluster="), part(3)).alias("guid_text"),
        F.concat(
            F.date_format(
                F.expr("timestamp_ntz'2016-12-05 10:00:00' + make_dt_interval(0, 0, page_id)"),
                "EEE, dd MMM yyyy HH:mm:ss",
            ),
            F.lit(" GMT"),
        ).alias("pub_date"),
    )


PAGE_ITEMS = rf"""page_items AS (
  SELECT CAST(page_id AS VARCHAR) AS item_id, page_id AS pos, url AS link, html,
         regexp_extract(url, '{URL_PARTS}', 1) AS feed,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(url, '{URL_PARTS}', 2) AS category,
         'cluster=' || regexp_extract(url, '{URL_PARTS}', 3) AS guid_text,
         TIMESTAMP '2016-12-05 10:00:00' + to_minutes(CAST(page_id AS INTEGER)) AS pub_ts
  FROM pages)"""


def nav_topics(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, pos, topic): link texts of the navigation block, from 0."""
    return table(spark, sf, "pages").select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit(NAV_LINK), F.lit(1))).alias("pos", "topic"),
    )


NAV_TOPICS = rf"""nav_lists AS (
  SELECT page_id, regexp_extract_all(html, '{NAV_LINK}', 1) AS l FROM pages),
nav_topics AS (
  SELECT page_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS topic
  FROM (SELECT page_id, l, unnest(range(len(l))) AS i FROM nav_lists))"""


# -- names ----------------------------------------------------------------------
def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words of the benchmark texts."""
    words = F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+"), F.lit(0))
    return (
        table(spark, sf, "benchmark")
        .select(F.explode(words).alias("entity"))
        .distinct()
        .withColumn("type", F.lit("PERSON"))
    )


GAZETTEER = r"""gazetteer AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '\b[A-Z][a-z]+')) AS entity FROM benchmark)"""


def long_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one to three words of the benchmark texts: long capitalised
    words, and capitalised words with one or two words after them."""
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in NAME_PATTERNS]
    return (
        table(spark, sf, "benchmark")
        .select(F.explode(F.concat(*found)).alias("entity"))
        .distinct()
        .withColumn("type", F.lit("PERSON"))
    )


NAME_PATTERNS = [r"\b[A-Z][a-z]{7,}", r"\b[A-Z][a-z]+ [a-z]+", r"\b[A-Z][a-z]+ [a-z]+ [a-z]+"]
LONG_NAMES = f"""gazetteer AS (
  SELECT DISTINCT unnest({" || ".join(f"regexp_extract_all(text, '{p}')" for p in NAME_PATTERNS)}) AS entity FROM benchmark)"""


# -- customers as contacts ---------------------------------------------------
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(
            F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
            F.lit("@"),
            F.lower("c_mktsegment"),
            F.lit(".example.com"),
        ).alias("email"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("association"),
        F.col("c_nationkey").cast("string").alias("state"),
    )


CONTACTS = """contacts AS (
  SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment)
           || '.example.com' AS email,
         c_name AS name, c_mktsegment AS association, CAST(c_nationkey AS VARCHAR) AS state
  FROM customer)"""


# -- orders as articles: stored before the cut, incoming from it on --------
def cut_date(spark: SparkSession, sf: str):
    """The 10 % quantile of the order dates (one value; the aggregation keeps
    one counter per distinct day)."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return days.agg(
        F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY unix_date(d))").cast("int").alias("d")
    ).select(F.date_from_unix_date("d").alias("d")).first()["d"]


def orders_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(stored orders, incoming orders); the cut reaches the scan as a literal."""
    cut = F.lit(cut_date(spark, sf)).cast("timestamp_ntz")
    orders = table(spark, sf, "orders")
    return orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut)


ORDERS_SPLIT = """cut AS (
  SELECT min(d) AS d FROM (
    SELECT o_orderdate AS d, sum(count(*)) OVER (ORDER BY o_orderdate) AS c
    FROM orders GROUP BY o_orderdate)
  WHERE c >= 0.1 * (SELECT count(*) FROM orders)),
stored_orders AS (SELECT * FROM orders WHERE o_orderdate < (SELECT d FROM cut)),
incoming_orders AS (SELECT * FROM orders WHERE o_orderdate >= (SELECT d FROM cut))"""


def stored_contacts(spark: SparkSession, sf: str, stored_orders: DataFrame) -> DataFrame:
    """Contacts with a stored order, as the journalist table."""
    wrote = contacts(spark, sf).join(
        stored_orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"
    )
    return dense_numbers(wrote, ["email"], "journalist_id")


STORED_CONTACTS = """stored_contacts AS (
  SELECT *, row_number() OVER (ORDER BY email) AS journalist_id
  FROM contacts WHERE c_custkey IN (SELECT o_custkey FROM stored_orders))"""


def incoming_contacts(spark: SparkSession, sf: str, incoming_orders: DataFrame) -> DataFrame:
    """Contacts with an incoming order."""
    return contacts(spark, sf).join(
        incoming_orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"
    )


INCOMING_CONTACTS = """incoming_contacts AS (
  SELECT * FROM contacts WHERE c_custkey IN (SELECT o_custkey FROM incoming_orders))"""

PEOPLE = ",\n".join([CONTACTS, ORDERS_SPLIT, STORED_CONTACTS, INCOMING_CONTACTS])

# -- parts as topics -----------------------------------------------------------

def beats(spark: SparkSession, sf: str) -> DataFrame:
    """The beat dimension: part types in the order of their names."""
    types = table(spark, sf, "part").select(F.col("p_type").alias("beat_topic")).distinct()
    return dense_numbers(types, ["beat_topic"], "beat_id").withColumn(
        "beat_id", F.col("beat_id").cast("int")
    )


BEATS = """beats AS (
  SELECT p_type AS beat_topic, CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS beat_id
  FROM (SELECT DISTINCT p_type FROM part))"""


def first_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, beat, topic) of the first line of every order."""
    # line number and part key packed into one long keep this a hash
    # aggregation; a struct minimum would sort both sides of the shuffle
    packed = F.shiftleft(F.col("l_linenumber").cast("bigint"), 48) + F.col("l_partkey")
    first = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min(packed).bitwiseAND(F.lit(2**48 - 1)).alias("p_partkey"))
    )
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("beat"), F.col("p_brand").alias("topic")
    )
    return first.join(part, "p_partkey").drop("p_partkey")


FIRST_PARTS = """first_parts AS (
  SELECT l.o_orderkey, p.p_type AS beat, p.p_brand AS topic
  FROM (SELECT l_orderkey AS o_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS p_partkey
        FROM lineitem GROUP BY l_orderkey) l
  JOIN part p USING (p_partkey))"""


def order_records(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    """Orders as crawl records: buyer = contact, order = article, first line =
    beat and topic. Orders without a line have no beat and no topic."""
    people = contacts(spark, sf).withColumnRenamed("c_custkey", "o_custkey")
    known = beats(spark, sf).withColumnRenamed("beat_topic", "beat")
    return (
        orders.join(people, "o_custkey")
        .join(first_parts(spark, sf), "o_orderkey", "left")
        .join(known, "beat", "left")
        .select(
            F.lit(0).alias("journalist_id"),
            "name",
            F.lit(None).cast("string").alias("designation"),
            "beat",
            "state",
            F.lit(None).cast("string").alias("country"),
            "email",
            F.lit(None).cast("string").alias("media_link"),
            F.lit(None).cast("string").alias("linkedin_url"),
            F.lit(None).cast("string").alias("website"),
            "association",
            F.lit(None).cast("string").alias("about_info"),
            F.col("o_orderdate").cast("timestamp").alias("publication_date"),
            F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("article_title"),
            F.concat(F.lit("http://news.example.com/"), F.col("o_orderkey").cast("string")).alias(
                "article_link"
            ),
            F.lit("orders").alias("feed"),
            F.col("o_orderkey").alias("pos"),
            F.coalesce("beat_id", F.lit(0)).alias("beat_id"),
            F.col("topic").alias("sub_beat_topic"),
        )
    )


ORDER_RECORDS = """order_records AS (
  SELECT o.o_orderkey AS pos, o.o_orderdate, c.email, c.name, c.association, c.state,
         o_orderpriority || CAST(o.o_orderkey AS VARCHAR) AS article_title,
         'http://news.example.com/' || CAST(o.o_orderkey AS VARCHAR) AS article_link,
         f.beat, f.topic AS sub_beat_topic, coalesce(b.beat_id, 0) AS beat_id
  FROM orders o JOIN contacts c ON c.c_custkey = o.o_custkey
  LEFT JOIN first_parts f ON f.o_orderkey = o.o_orderkey
  LEFT JOIN beats b ON b.beat_topic = f.beat)"""

RECORDS = ",\n".join([PEOPLE, BEATS, FIRST_PARTS, ORDER_RECORDS])


# -- conversations as contact profiles ------------------------------------------
def profile_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as profile entries; values repeat inside a conversation."""
    tags = F.array(*(F.lit(t) for t in PROFILE_TAGS))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item_id"),
        F.col("turn").alias("pos"),
        F.element_at(tags, (F.col("turn") % 4 + 1).cast("int")).alias("tag"),
        F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0), F.lit(""))
        .otherwise(F.concat_ws(",", "role", (F.col("turn") % 5).cast("string")))
        .alias("value"),
    )


# fixed order: position in this list = turn modulo 4
PROFILE_TAGS = ["email", "Loc", "bio", "email"]

PROFILE_ENTRIES = """profile_entries AS (
  SELECT conv_id AS item_id, turn AS pos,
         ['email', 'Loc', 'bio', 'email'][turn % 4 + 1] AS tag,
         CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN ''
              ELSE role || ',' || CAST(turn % 5 AS VARCHAR) END AS value
  FROM conversations)"""
