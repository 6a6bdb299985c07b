"""Scalar functions: (input, expected) pairs."""

import pytest
from pyspark.sql import functions as F

from newsgraph.functions import dates, text

CASES = {
    "email": (text.last_email, [
        ("nothing here", ""), ("a.b@example.com", "a.b@example.com"),
        ("x@example.com then Y@Example.ORG.", "Y@Example.ORG"),
        ("root@192.168.1.20 ok", "root@192.168.1.20"), ("a@b", ""), ("me@example.museum", "me@example.muse"),
        ("", ""), (None, ""),
    ]),
    "clean": (text.clean_html, [
        ("&amp;lt;", "&lt;"), ("&amp;nbsp;x", "x"), ("a.b,c'd", "abcd"), ("&lt;b&gt;&quot;", '<b>"'),
        ("one\r\ntwo&raquo;", "onetwo"), ("&apos;", ""), (None, None),
    ]),
    "escape": (text.escape_xml, [("a<b & 'c' \"d\">", "a&lt;b &amp; &apos;c&apos; &quot;d&quot;&gt;")]),
    "comma": (text.name_before_comma, [("Jane, Staff, X", "Jane"), ("Jane", "Jane"), (",x", ""), ("", "")]),
    "words": (text.location_words, [
        ("New-York, 9abc d'Or 77", ["New-York", "abc", "d'Or"]), ("", []), ("12 34", []),
    ]),
    "state": (text.state_of, [("Ohio,USA", "Ohio"), ("Ohio", "Ohio"), ("", None), (None, None)]),
    "country": (text.country_of, [("Ohio,USA,x", "USA"), ("Ohio", None), ("", None)]),
    "publisher": (text.publisher_of, [("a - b - pub", " pub"), ("none", "none"), ("x-", "")]),
    "cluster": (text.cluster_id, [("t,cluster=5", "5"), ("none", None), ("a=b=c", "b"), ("a=", "")]),
    "numeric": (text.is_numeric, [
        ("12", True), (" 12 ", True), ("1,000", True), ("abc", False), ("", False), ("1.5", True), (None, False),
        ("12d", False), ("1e5", True), ("-.5", True), (".", False), ("1.2.3", False),
    ]),
    "link": (text.link_class, [
        ("http://twitter.com/a", "twitter"), ("https://www.linkedin.com/in/a", "linkedin"),
        ("mailto:a@b.co", "email"), ("/x", None),
    ]),
    "absolute": (text.is_absolute_link, [("http://x", True), ("/x", False), ("https://x", False)]),
    "trim": (text.trim_ws, [("\t a b \n", "a b"), ("", ""), (None, None), ("x", "x")]),
    "stamp": (lambda c: F.date_format(dates.exact_timestamp(c), "yyyyMMddHHmmss"), [
        ("2016-12-05 10:00:00", "20161205100000"), ("2016-12-05", None), ("soon", None),
        ("2016-13-05 10:00:00", None), (" 2016-12-05 10:00:00", None),
    ]),
    "feed date": (lambda c: F.date_format(dates.feed_timestamp(c), "yyyyMMddHHmmss"), [
        ("Mon, 05 Dec 2016 10:00:00 GMT", "20161205100000"), ("bad", None), ("a|b|c|d|e|f", None),
        ("5 Dec 16 9:05", "20161205090500"), ("05 December 2016 10:00 CEST", None), ("05 Dec 2016 10:00 +0130", "20161205083000"),
        ("Tue, 6 Dec 1999 23:59:59 est", "19991207045959"), ("32 Dec 2016 10:00", None), (None, None), ("", None),
    ]),
    "int": (dates.to_int, [("12", 12), ("x", None), ("", None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar(spark, name):
    function, pairs = CASES[name]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, t string")
    got = [r[0] for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").select("v").collect()]
    assert got == [p[1] for p in pairs]


def test_labels_and_codec(spark):
    df = spark.sql("select timestamp'2016-12-05 09:08:07' ts, 'bio' tag, 'a:b' v, cast(null as string) n")
    got = df.select(
        dates.day_label(F.col("ts")), dates.clock_label(F.col("ts")),
        text.entry_text(F.col("tag"), F.col("v")), text.entry_text(F.col("tag"), F.col("n")),
        text.entry_of(F.lit("bio:a:b")),
    ).first()
    assert list(got)[:4] == ["5 Dec 2016", "05/12/2016 09:08:07", "bio:a:b", "bio:"]
    assert tuple(got[4]) == ("bio", "a:b")


def test_unicode_flag(spark):
    df = spark.sql("select 'Köln und Łódź' t, ' x ' s")
    got = df.select(text.location_words(F.col("t"), unicode=True), text.trim_ws(F.col("s"), unicode=True)).first()
    assert list(got) == [["Köln", "und", "Łódź"], "x"]


def test_trim_is_idempotent(spark):
    df = spark.createDataFrame([("\t x \n",), ("  ",), (None,)], "t string")
    once = text.trim_ws(F.col("t"))
    assert df.where(~once.eqNullSafe(text.trim_ws(once))).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_feed_dates_in_any_session_zone(spark, zone):
    cases = [("Mon, 05 Dec 2016 10:00:00 GMT", 10), ("Mon, 5 Dec 2016 10:00:00 +0200", 8), ("5 Dec 2016 10:00 EST", 15),
             ("monday, 05 december 2016 10:00:00 Z", 10), ("05 Dec 16 10:00:00", 10), ("05 Dec 2016", None),
             ("Mon, 55 Dec 2016 10:00:00 GMT", None), ("", None), (None, None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
        got = {r.i: r.t for r in df.select("i", F.unix_timestamp(dates.feed_timestamp(F.col("s"))).alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    day = 17140 * 86_400  # 2016-12-05
    assert got == {i: None if h is None else day + h * 3600 for i, (_, h) in enumerate(cases)}
