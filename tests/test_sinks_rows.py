import datetime as dt
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from newsgraph.functions import rows as rw
from newsgraph.sinks.changelog import drop_old_logs, kept, log_layout, write_log
from newsgraph.staging import scope, stage, stage_counted

COLUMNS = ("journalist_id int, Name string, designation string, state string, country string, email string, "
           "media_link string, linkedin_url string, website string, association string, about_info string, tags string")


def people(spark, about='says "hi", twice'):
    return spark.createDataFrame([(1, "N", None, "Ohio", None, "n@example.com", "m", "li", None, "Wire", about, None)], COLUMNS)


def test_log_layout_ignores_case(spark):
    assert log_layout(people(spark)).columns == [
        "email", "Name", "state", "country", "association", "media_link", "website", "about_info", "linkedin_url"]


def test_log_text(spark, tmp_path):
    day = dt.date(2016, 12, 5)
    path = write_log(people(spark).coalesce(1), str(tmp_path), day, 7)
    write_log(people(spark).coalesce(1), str(tmp_path), day, 7)  # the same batch again
    text = "".join(p.read_text() for p in sorted(Path(path).glob("part-*.csv")))
    assert text == (
        '"email","Name","state","country","association","media_link","website","about_info","linkedin_url"\n'
        '"n@example.com","N","Ohio","","Wire","m","","says ""hi"", twice","li"\n')


def test_retention(spark, tmp_path):
    for day in (1, 2, 5):
        write_log(people(spark), str(tmp_path), dt.date(2016, 12, day), 1)
    assert drop_old_logs(spark, str(tmp_path), dt.date(2016, 12, 5)) == ["2016-12-01"]
    assert sorted(p.name for p in tmp_path.glob("log_date=*")) == ["log_date=2016-12-02", "log_date=2016-12-05"]
    assert drop_old_logs(spark, str(tmp_path / "none"), dt.date(2016, 12, 5)) == []
    df = spark.sql("select explode(array(timestamp'2016-12-01', timestamp'2016-12-02', timestamp'2016-12-05')) ts")
    assert kept(df, "ts", F.lit(dt.datetime(2016, 12, 5))).count() == 2


def test_row_filters(spark):
    df = spark.createDataFrame([("a", True), ("", False), (None, None)], "t string, f boolean")
    assert rows(rw.with_text(df, "t"), "t") == [("a",)]
    assert rows(rw.without_empty(df, "t"), "t") == [("a",), (None,)]
    yes, no = rw.split_on(df, F.col("f"))
    assert rows(yes, "t") == [("a",)] and rows(no, "t") == [("",), (None,)]


def test_projections(spark):
    df = spark.sql("select ' x\t' a, 1 b, cast(null as string) c")
    assert rows(rw.trim_all(df)) == [("x", 1, None)]
    work = spark.sql("select 1 article_id, 2 sub_beat_id, 'x' other")
    assert rows(rw.bridge_part(work)) == [(None, 1, 2)]
    crawl = spark.sql("select 'e' email, 'b' beat, 1 article_id, 'p' publication_date, 't' article_title, 'l' article_link, 0 journalist_id")
    assert rw.journalist_part(crawl).columns == ["email", "journalist_id"]
    assert rw.article_part(crawl).columns == ["article_id", "publication_date", "article_title", "article_link", "journalist_id"]
    sub = spark.sql("select 1 journalist_id, 1 article_id, 1 sub_beat_id, 't' sub_beat_topic, 1 news_id, 2 beat_id, '' guid_text, 1 channel_id, '' beat_link, '' cid")
    assert rw.sub_beat_part(sub).columns == ["sub_beat_id", "sub_beat_topic", "beat_id"]


def test_stage_scope(spark):
    with scope(spark):
        df, n = stage_counted(spark.range(10), "t", F.col("id") < 4)
        other = stage(spark.range(3))
        files = df.inputFiles() + other.inputFiles()
        assert n == 4 and df.count() == 10 and other.count() == 3
    assert not any(Path(f.removeprefix("file:").removeprefix("//")).exists() for f in files)
