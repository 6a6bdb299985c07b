"""A news site derived from the customer table: one item, up to three landed
pages (article, author page, profile page) and one beat page per customer.

The remainder of the customer key by 8 picks the shape of the article page:

0 author link and icon list      4 other byline, icon list without e-mail
1 absolute author link           5 absolute author link, icon list without e-mail
2 relative author link, fallback 6 byline without contacts
3 plain byline and e-mail icon   7 article page not landed
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.catalog.text_queries import SQL_CLEAN
from newsgraph.catalog.views import dense_numbers, table

_TEXTS = {
    "link": "'http://news.example.com/a/' || k",
    "by_url": "'http://news.example.com/by/' || k",
    "tw_url": "'http://twitter.com/u' || k",
    "li_url": "'http://www.linkedin.com/in/u' || k",
    "beat_url": "'http://beats.example.com/' || k",
    "desk_email": "'e' || k || '@desk.example.com'",
    "own_email": "'p' || k || '@mail.example.com'",
    "writer": "n_name || ' Writer'",
    "guid_text": "CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE 'tag:x,cluster=' || k END",
    "title": "'Story &quot;' || k || '&quot; - The Daily ' || c_mktsegment",
    "bio": """'Covers R&amp;D, in ' || n_name || '. Mail me: '
      || CASE WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE 'p' || k || '@mail.example.com' END""",
}

# the same column texts are valid in Spark and in DuckDB
SITE = f"""site AS (
  SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in _TEXTS.items())}
  FROM (SELECT c_custkey, c_mktsegment, n_name, n_regionkey < 3 AS known, c_custkey % 8 AS shape,
               CAST(c_custkey AS VARCHAR) AS k
        FROM customer JOIN nation ON n_nationkey = c_nationkey))"""


def site(spark, sf) -> DataFrame:
    base = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            "c_custkey", "c_mktsegment", "n_name",
            (F.col("n_regionkey") < 3).alias("known"),
            (F.col("c_custkey") % 8).alias("shape"),
            F.col("c_custkey").cast("string").alias("k"),
        )
    )
    return base.select("*", *(F.expr(sql).alias(name) for name, sql in _TEXTS.items()))


def names(spark, sf) -> DataFrame:
    """The gazetteer: all nations, those beyond the first three regions under a
    name that no page has."""
    name = F.when(F.col("n_regionkey") < 3, F.col("n_name")).otherwise(F.concat(F.lit("Old "), "n_name"))
    return table(spark, sf, "nation").select(name.alias("entity"), F.lit("LOCATION").alias("type"))


def _html(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _icons(*kinds: str) -> Column:
    href = {"email": _html("mailto:", F.col("desk_email")), "twitter": F.col("tw_url"),
            "linkedin": F.col("li_url")}
    links = [x for kind in kinds
             for x in (f"<li><a class='author icon {kind}' href=\"", href[kind], '">x</a></li>')]
    return _html('<ul class="author-info">', *links, "</ul>")


def _byline(open_tag: str | Column, close: str, tail: str = ", Staff") -> Column:
    return _html("<p>By ", open_tag, F.col("writer"), tail, close, "</p>")


def _article() -> Column:
    absolute = _byline(_html('<a rel="author" href="', F.col("by_url"), '">'), "</a>")
    shapes = {
        0: _html(_byline('<a rel="author" href="/x">', "</a>"), _icons("email", "twitter", "linkedin")),
        1: absolute,
        2: _html(_byline("<a href=/x rel=author>", "</a>"), '<a class="author-twitter" href="',
                 F.col("tw_url"), '">t</a><br><a class="author-linkedin" href="', F.col("li_url"), '">l</a>'),
        3: _html(_byline('<span class="name">', "</span>"), _icons("email")),
        4: _html(_byline("<span class='asset-metabar-author asset-metabar-item'>", "</span>", ""),
                 _icons("twitter")),
        5: _html(absolute, _icons("twitter")),
        6: _byline('<span class="name">', "</span>", ""),
    }
    body = F.lit(None).cast("string")
    for shape, html in shapes.items():
        body = F.when(F.col("shape") == shape, html).otherwise(body)
    return _html("<html><head><script>var a = '<a rel=author>';</script></head><body>",
                 '<a class="author icon email" href="mailto:other@example.com">outside</a>',
                 body, "<!-- <a rel=author> --></body></html>")


def _bio_page() -> Column:
    item = lambda href: _html(
        '<li class="social-icon-list-item"><a href="', href, '"><i>x</i></a></li>')
    return _html("<ul>", item(F.col("tw_url")), item(F.col("li_url")),
                 item(_html("mailto:", F.col("own_email"))), "</ul>")


def _profile_page() -> Column:
    return _html(
        '<div class="ProfileHeaderCard"><h1>x</h1><p class="ProfileHeaderCard-bio u-dir">',
        F.col("bio"), '</p><div class="ProfileHeaderCard-location"> <span class="i"></span> <span>',
        "Greater ", F.col("n_name"), ", R9</span> </div></div>")


def _beat_page() -> Column:
    topic = lambda text: _html('<div class="esc-topic-wrapper">', text, "</div>")
    story = lambda cid, *topics: _html(
        '<div class="story anchorman-blended-story esc esc-has-thumbnail " cid="', cid,
        '"><div class="esc-inner esc-collapsed"><div class="esc-topics-wrapper">',
        *(topic(t) for t in topics), "</div></div></div>")
    return _html(story(_html("9", F.col("k")), F.lit("Wrong one")),
                 story(F.col("k"), _html(" ", F.col("c_mktsegment"), " "),
                       _html(F.col("n_name"), " news"), F.lit("2016-12-05 10:00:00")))


def pages(spark, sf) -> DataFrame:
    """Landed pages (url, html, landed_at) of the whole site, each in two
    versions: the older ones show other bylines, contacts, places and topics."""

    def versions(rows: DataFrame, day: int) -> DataFrame:
        page = lambda url, html: F.struct(F.col(url).alias("url"), html.alias("html"))
        landed = F.array(page("link", _article()), page("by_url", _bio_page()),
                         page("tw_url", _profile_page()), page("beat_url", _beat_page()))
        return rows.select(F.inline(F.filter(landed, lambda p: p["html"].isNotNull()))).withColumn(
            "landed_at", F.lit(f"2016-12-0{day} 00:00:00").cast("timestamp"))

    newest = site(spark, sf)
    # addresses stay, what the pages say is that of another shape and other people
    old = newest.withColumns({
        "shape": F.when(F.col("shape") == 7, 7).otherwise((F.col("shape") + 3) % 7),
        "desk_email": F.concat(F.lit("old"), "desk_email"), "own_email": F.concat(F.lit("old"), "own_email"),
        "writer": F.concat(F.lit("Old "), "writer"), "bio": F.lit("Was away. Mail me: gone@mail.example.com"),
        "li_url": F.concat("li_url", F.lit("/old")), "c_mktsegment": F.lit("OLD TOPIC"), "n_name": F.lit("Atlantis"),
    })
    return versions(newest, 5).unionByName(versions(old, 1))


def items(spark, sf) -> DataFrame:
    """Feed items (one per customer)."""
    return site(spark, sf).select(
        F.col("k").alias("item_id"),
        (F.col("c_custkey") % 10).cast("string").alias("feed"),
        F.col("c_custkey").alias("pos"),
        F.col("beat_url").alias("beat_link"),
        "title", "link",
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("category"),
        F.lit("Mon, 05 Dec 2016 10:00:00 GMT").alias("pub_date"),
        "guid_text",
    )


def segment_beats(spark, sf) -> DataFrame:
    """Market segments, numbered by name; one under a name that no item has."""
    name = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("OTHER")).otherwise(F.col("c_mktsegment"))
    segments = table(spark, sf, "customer").select(name.alias("beat_topic")).distinct()
    return dense_numbers(segments, ["beat_topic"], "beat_id").withColumn(
        "beat_id", F.col("beat_id").cast("int"))


SEGMENT_BEATS = """segment_beats AS (
  SELECT beat_topic, CAST(row_number() OVER (ORDER BY beat_topic) AS INTEGER) AS beat_id FROM (
    SELECT DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'OTHER' ELSE c_mktsegment END AS beat_topic FROM customer))"""

# what the pages say, by shape
FOUND = f"""{SITE},
found AS (
  SELECT *, CASE WHEN shape IN (0, 3) THEN desk_email
              WHEN shape IN (1, 2, 5) AND c_custkey % 3 <> 0 THEN own_email END AS email,
    CASE WHEN known THEN writer END AS name,
    CASE WHEN shape <> 3 AND known THEN n_name END AS state,
    CASE WHEN shape = 3 THEN '' ELSE tw_url END AS media_link,
    CASE WHEN shape = 3 THEN '' ELSE li_url END AS linkedin_url,
    CASE WHEN shape IN (1, 5) THEN by_url END AS website,
    CASE WHEN shape <> 3 THEN {SQL_CLEAN('bio')} END AS about_info,
    CASE WHEN known THEN c_mktsegment ELSE n_name || ' news' END AS last_topic
  FROM site)"""
