"""Golden pages: picks, bylines, contacts, profiles, story topics."""

import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newsgraph.operators.contacts import article_facts, contact_entries
from newsgraph.operators.elements import Pick, may_match, scan
from newsgraph.operators.profile import contact_rows
from newsgraph.operators.topics import attach_topics, story_topics, valid_topics
from newsgraph.plans.crawl import ALL_PICKS, picked_pages


@pytest.fixture(scope="module")
def picked(site_pages):
    return picked_pages(site_pages).cache()


@pytest.fixture(scope="module")
def contacts(spark, picked, gazetteer):
    names = ["icons", "nobyline", "authorpage", "relative", "namespan", "metabar", "noemail", "missing"]
    items = spark.createDataFrame([(n, f"http://news.example.com/{n}") for n in names], "item_id string, link string")
    found = contact_rows(contact_entries(items, picked, gazetteer)).collect()
    return {r["item_id"]: r.asDict() for r in found}


def test_scan_scope_and_text():
    html = "<div id=a><p class='x'>one<b>two</b></p><br>tail</div><p class='x'>three"
    picks = [Pick("box", "div", "id", "a"), Pick("p", "p", "class", "x"), Pick("in", "p", inside="box"),
             Pick("child", child_of="box")]
    got = [(r[0], r[3], r[-1]) for r in scan(html, picks)]
    assert got == [("box", 0, "onetwotail"), ("p", 1, "onetwo"), ("in", 1, "onetwo"), ("child", 1, "onetwo"),
                   ("child", 2, ""), ("p", 0, "three")]


def test_scan_odd_markup():
    picks = [Pick("a", "a")]
    assert scan(None, picks) == [] and scan("", picks) == []
    assert [r[4] for r in scan("<A HREF='x'>1<a href=y>2</b></a><!-- <a href=z> --><a", picks)] == ["x", "y"]
    assert scan("<script><a href=x></a></script>", picks) == []
    assert [r[-1] for r in scan("a < b <a>c > d</a>", picks)] == ["c > d"]


def test_scan_quote_inside_a_bare_value():
    html = "<p title=don't>x</p><a rel=author href=http://x>Jane</a> it's"
    assert [(r[4], r[-1]) for r in scan(html, [Pick("a", "a", "rel", "author")])] == [("http://x", "Jane")]
    assert [r[4] for r in scan("<a x=y href = 'a>b' \"><a href=\"\">", [Pick("a", "a")])] == ["a>b", ""]


def test_scan_cut_off_page():
    picks = [Pick("a", "a")]
    assert [r[-1] for r in scan("<a>one</a><a href='x", picks)] == ["one"]
    assert [r[-1] for r in scan("<a>one<!-- <a>two", picks)] == ["one"]
    assert [r[-1] for r in scan("<a>one<b title=\"", picks)] == ["one"]


@pytest.mark.parametrize("part", ["<a b ", "<a b='", "<a b=\"'", "<!x ", "<a =", "</a ", "<!--", "<i>", "<script>"])
def test_scan_is_linear(part):
    started = time.perf_counter()
    scan(part * (400_000 // len(part)), [Pick("a", "a"), Pick("b", "b", inside="a")])
    assert time.perf_counter() - started < 5  # quadratic time takes minutes


def test_pre_filter_drops_no_match(spark, site_pages):
    odd = [("1", "<SPAN CLASS = name>"), ("2", "<div class='x name'>"), ("3", "<a REL=\n'author'>"), ("4", "author")]
    pages = site_pages.unionByName(spark.createDataFrame(odd, "url string, html string"))
    kept = {r["url"] for r in pages.where(may_match(ALL_PICKS)).collect()}
    found = {r["url"] for r in pages.collect() if scan(r["html"], ALL_PICKS)}
    assert {"1", "3"} <= found <= kept and not {"2", "4"} & kept


def test_icon_list_is_scoped_to_its_block(contacts):
    got = contacts["icons"]
    assert got["email"] == "jane@example.com"  # the last address of the icon, not the one outside
    assert got["name"] == "Jane Doe"
    assert got["media_link"] == "http://twitter.com/jane"
    assert got["linkedin_url"] == "http://www.linkedin.com/in/jane"
    assert got["website"] is None
    assert got["state"] == "Ohio" and got["country"] is None


def test_bio_text_does_not_overwrite_email(contacts):
    assert contacts["icons"]["about_info"] == "Reporter email: none &lt;3 news"


def test_icon_list_without_byline(contacts):
    got = contacts["nobyline"]
    assert (got["email"], got["name"], got["media_link"], got["linkedin_url"]) == ("desk@example.com", None, "", "")


def test_author_page(contacts):
    got = contacts["authorpage"]
    assert got["email"] == "ann.lee@news.example.org"  # the profile comes before the mailto link
    assert got["website"] == "http://news.example.com/by/ann"
    assert got["media_link"] == "http://twitter.com/ann"
    assert got["linkedin_url"] == "http://www.linkedin.com/in/fallback"  # the last entry wins
    assert got["name"] == "Ann Lee"


def test_relative_author_link_uses_fallback(contacts):
    got = contacts["relative"]
    assert got["email"] == "ann.lee@news.example.org" and got["website"] is None


def test_other_bylines(contacts):
    assert contacts["namespan"]["name"] == "Jane Doe"
    assert contacts["metabar"]["name"] is None  # not an entity
    assert contacts["metabar"]["email"] == "meta@example.com"


def test_empty_first_email_and_missing_page_are_dropped(contacts):
    assert set(contacts) == {"icons", "nobyline", "authorpage", "relative", "namespan", "metabar"}


def test_facts_of_relative_link(picked):
    got = article_facts(picked).where("url = 'http://news.example.com/relative'").first()
    assert got["author_href"] == "/by/ann" and got["author_url"] is None and got["has_author"]


def test_story_topics(spark, picked, gazetteer):
    topics = valid_topics(story_topics(picked), gazetteer)
    page = "http://beats.example.com/business"
    assert rows(topics, "beat_link", "cid", "topic") == sorted([
        (page, "555", "Housing & rent"), (page, "555", "Interest rates"), (page, "999", "First story topic"),
    ])
    work = spark.createDataFrame([(page, "555"), (page, None), (page, "777"), ("x", "555")], "beat_link string, cid string")
    assert rows(attach_topics(work, topics), "cid", "sub_beat_topic") == sorted(
        [("555", "Housing & rent"), (None, None), ("777", None), ("555", None)], key=repr)
    both = attach_topics(work, topics, "all").where(F.col("sub_beat_topic").isNotNull())
    assert both.count() == 2
