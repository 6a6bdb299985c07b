"""Bylines and author contacts from article, bio and profile pages.

Input is the picked-elements table of the landed pages. Output is rows
``(item_id, pos, tag, value)``; ``pos`` orders the entries of one item as
section, link inside the page, step, entry inside a profile card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions.text import is_absolute_link, last_email, location_words, name_before_comma
from newsgraph.operators.elements import Pick, all_of, first_of
from newsgraph.operators.entity import last_entity_word, with_gate
from newsgraph.sources.picked import PickedPages
from newsgraph.sources.tables import LANDED
from newsgraph.staging import stage

# The elements that carry contacts.
ARTICLE_PICKS = [
    Pick("author", "a", "rel", "author"),
    Pick("name_span", "span", "class", "name"),
    Pick("metabar_span", "span", "class", "asset-metabar-author asset-metabar-item"),
    Pick("icons", "ul", "class", "author-info"),
    Pick("icon_email", "a", "class", "author icon email", inside="icons"),
    Pick("icon_twitter", "a", "class", "author icon twitter", inside="icons"),
    Pick("icon_linkedin", "a", "class", "author icon linkedin", inside="icons"),
    Pick("twitter", "a", "class", "author-twitter"),
    Pick("linkedin", "a", "class", "author-linkedin"),
]
BIO_PICKS = [
    Pick("social_item", "li", "class", "social-icon-list-item"),
    Pick("social_link", "a", child_of="social_item"),
]
PROFILE_PICKS = [
    Pick("card", "div", "class", "ProfileHeaderCard"),
    Pick("card_text", "p", child_of="card"),
    Pick("card_bio", "p", "class", "ProfileHeaderCard-bio u-dir", inside="card"),
    Pick("card_location", "div", "class", "ProfileHeaderCard-location", child_of="card"),
    Pick("location_part", child_of="card_location"),
]

# Order of the sources of one profile.
NAME, ICONS, BIO_PAGE, FALLBACK = range(4)
_PROFILE = "@profile"  # marks a row that still has to be looked up


def _pos(section: int, step: int, link: Column | None = None) -> Column:
    inside = F.lit(0) if link is None else link
    return (
        F.lit(section * 10**13 + step * 10**5).cast("bigint") + inside.cast("bigint") * 10**6
    )


def _entry(pos: Column, tag: str, value: Column, when: Column) -> Column:
    return F.when(
        when, F.struct(pos.alias("pos"), F.lit(tag).alias("tag"), value.alias("value"))
    )


def _entry_rows(df: DataFrame, *entries: Column) -> DataFrame:
    """Explode the entries that apply to (item_id, pos, tag, value)."""
    return df.select(
        "item_id", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    )


def article_facts(picked: DataFrame, *keep: str) -> DataFrame:
    """One row per page with the byline text and the contact links it shows,
    next to the columns in ``keep``."""
    icons = first_of("icons")["pos"]
    byline = F.coalesce(*(first_of(n)["text"] for n in ("author", "name_span", "metabar_span")))
    facts = picked.select(
        *keep,
        "url",
        name_before_comma(byline).alias("byline"),
        first_of("author").isNotNull().alias("has_author"),
        first_of("author")["href"].alias("author_href"),
        icons.isNotNull().alias("has_icons"),
        first_of("icon_email", icons)["href"].alias("icon_email"),
        first_of("icon_twitter", icons)["href"].alias("icon_twitter"),
        first_of("icon_linkedin", icons)["href"].alias("icon_linkedin"),
        first_of("twitter")["href"].alias("twitter"),
        first_of("linkedin")["href"].alias("linkedin"),
    )
    has_email = F.col("has_icons") & F.col("icon_email").isNotNull()
    follows = F.col("has_author") & ~has_email & is_absolute_link(F.col("author_href"))
    return facts.withColumn("has_email_icon", has_email).withColumn(
        "author_url", F.when(follows, F.col("author_href"))
    )


def byline_entries(facts: DataFrame, gazetteer: DataFrame | None, model=None) -> DataFrame:
    """Name entries: bylines that the gate takes for an entity."""
    named = facts.where(F.col("byline") != "").select("item_id", "byline")
    return (
        with_gate(named, "byline", gazetteer, model)
        .where(~F.col("is_topic"))
        .select("item_id", _pos(NAME, 0).alias("pos"), F.lit("name").alias("tag"),
                F.col("byline").alias("value"))
    )


def page_entries(facts: DataFrame) -> DataFrame:
    """Entries of the article page itself; profile links are still marked."""
    has_icons, has_email = F.col("has_icons"), F.col("has_email_icon")
    no_email = ~has_email
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    return _entry_rows(
        facts,
        _entry(_pos(ICONS, 0), "email", last_email(F.col("icon_email")), has_email),
        _entry(_pos(ICONS, 0), "email", F.lit(""), has_icons & no_email & ~F.col("has_author")),
        _entry(_pos(ICONS, 1), "Media link", text("icon_twitter"), has_icons),
        _entry(_pos(ICONS, 2), _PROFILE, F.col("icon_twitter"),
               has_icons & F.col("icon_twitter").isNotNull()),
        _entry(_pos(ICONS, 3), "LinkedIn", text("icon_linkedin"), has_icons),
        _entry(_pos(BIO_PAGE, 0), "website", F.col("author_url"), F.col("author_url").isNotNull()),
        _entry(_pos(FALLBACK, 1), "Media link", F.col("twitter"),
               no_email & F.col("twitter").isNotNull()),
        _entry(_pos(FALLBACK, 2), _PROFILE, F.col("twitter"),
               no_email & F.col("twitter").isNotNull()),
        _entry(_pos(FALLBACK, 3), "LinkedIn", F.col("linkedin"),
               no_email & F.col("linkedin").isNotNull()),
    )


def bio_links(picked: DataFrame) -> DataFrame:
    """(url, link_pos, href) of the social links on bio pages."""
    return picked.select(
        "url", F.explode(F.filter(all_of("social_link"), lambda e: e["href"].isNotNull())).alias("e")
    ).select("url", F.col("e.pos").alias("link_pos"), F.col("e.href").alias("href"))


def bio_entries(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Entries of the author page behind an absolute author link."""
    linked = (
        facts.where(F.col("author_url").isNotNull())
        .select("item_id", F.col("author_url").alias("url"))
        .join(links, "url")
    )
    href, at = F.col("href"), F.col("link_pos") + 1
    has = lambda part: F.contains(href, F.lit(part))
    return _entry_rows(
        linked,
        _entry(_pos(BIO_PAGE, 1, at), "Media link", href, has("twitter.com")),
        _entry(_pos(BIO_PAGE, 2, at), _PROFILE, href, has("twitter.com")),
        _entry(_pos(BIO_PAGE, 3, at), "LinkedIn", href, has("linkedin.com")),
        _entry(_pos(BIO_PAGE, 4, at), "email", last_email(href), has("mailto:")),
    )


def profile_facts(picked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(url, email, bio, place) of the profile cards.

    The place is the last word of the location that the gazetteer knows; it is
    null when there is none, which leaves an earlier place untouched.
    """
    card = first_of("card")["pos"]
    bio = F.when(
        first_of("card_text", card).isNotNull(), first_of("card_bio", card)["text"]
    )
    place = F.try_element_at(all_of("card_location", card), F.lit(-1))["pos"]
    second = F.filter(all_of("location_part", place), lambda e: e["nth"] == 2)
    cards = picked.where(card.isNotNull()).select(
        "url",
        bio.alias("bio"),
        last_email(bio).alias("email"),
        location_words(F.try_element_at(second, F.lit(1))["text"]).alias("words"),
    )
    places = last_entity_word(cards, "url", "words", gazetteer)
    return cards.select("url", "email", "bio").join(
        places.withColumnRenamed("word", "place"), "url", "left"
    )


def resolve_profiles(entries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Replace the marked rows by the entries of their profile page."""
    marked = F.col("tag") == _PROFILE
    looked_up = (
        entries.where(marked)
        .select("item_id", F.col("pos").alias("at"), F.col("value").alias("url"))
        .join(profiles, "url")
    )
    at = F.col("at")
    found = _entry_rows(
        looked_up,
        _entry(at + 1, "email", F.coalesce("email", F.lit("")), F.col("bio").isNotNull()),
        _entry(at + 2, "bio", F.col("bio"), F.col("bio").isNotNull()),
        _entry(at + 3, "Loc", F.col("place"), F.col("place").isNotNull()),
    )
    return entries.where(~marked).unionByName(found)


def newest_picks(picked: DataFrame) -> DataFrame:
    """(url, picks) of every page in its newest version; pages without versions as they are."""
    if LANDED not in picked.columns:
        return picked
    newest = picked.groupBy("url").agg(F.max(F.struct(LANDED, "picks")).alias("_newest"))
    return newest.select("url", "_newest.picks").where(F.size("picks") > 0)


def pages_of(picked: DataFrame | PickedPages, links: DataFrame) -> DataFrame:
    """The picked pages (url, picks) that any of the links lead to, each once, in its newest version."""
    wanted = links.where(F.col("url").isNotNull()).distinct()
    rows = picked.lookup(wanted) if isinstance(picked, PickedPages) else picked
    return newest_picks(rows.join(wanted, "url", "left_semi"))


def contact_entries(
    items: DataFrame, picked: DataFrame | PickedPages, gazetteer: DataFrame, model=None
) -> DataFrame:
    """All profile entries of the items ``(item_id, link)``.

    Three equi-joins on page addresses: article, author page, profile page. An
    item whose article page was not landed gives no entries. Only pages that
    the items lead to are looked at, so a small batch costs a scan of the
    picked table, or of a few of its files if that is stored by address. Facts and entries feed several branches and are
    written once.
    """
    links = items.select("item_id", F.col("link").alias("url"))
    facts = stage(article_facts(links.join(pages_of(picked, links.select("url")), "url"), "item_id"), "facts")
    authors = pages_of(picked, facts.select(F.col("author_url").alias("url")))
    rows = stage(
        page_entries(facts).unionByName(bio_entries(facts, bio_links(authors))), "entries"
    )
    profiles = pages_of(picked, rows.where(F.col("tag") == _PROFILE).select(F.col("value").alias("url")))
    return resolve_profiles(rows, profile_facts(profiles, gazetteer)).unionByName(
        byline_entries(facts, gazetteer, model)
    )
