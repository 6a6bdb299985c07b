"""Warc, url, sharding and mix queries against plain Python, with nulls and repeats."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from newsgraph.llm import queries

DOCS = [(1, "a b c", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, "a b c", "en", "s2"),
        (5, "w " * 3000, "en", None), (6, " \n", "de", "s3"), (7, "x y", "en", "s3"), (8, "ä ö ü " * 50, "de", "s1")]
BIG = "<p>é</p>" * 200
PAGES = [(1, "http://example.com/en/a", BIG), (2, "http://www.example.com/en/a", BIG), (3, "https://a.net/es/x", "<p>x</p>"),
         (4, "https://a.net/EN/x", "<p>x</p>"), (5, None, None), (6, "nothing", ""), (7, "http://SUB.example.com/en/?q", BIG),
         (8, "http://notexample.com/en/", BIG + "!"), (9, "http://net/fr/", None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, len(d[1] or ""), 0) for d in DOCS],
                          "doc_id long, text string, lang string, source string, n_chars long, size int"
                          ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*p, "en", "x") for p in PAGES],
                          "page_id long, url string, html string, lang string, host string"
                          ).write.parquet(f"{path}/pages.parquet")
    return path


def test_warc(spark, tables):
    got = {r.page_id: r for r in queries.op6_warc_index(spark, tables).collect()}
    assert sorted(got) == [p[0] for p in PAGES]
    for page, _, html in PAGES:
        payload = (html or "").encode()
        last = max(p for p, _, h in PAGES if (h or "") == (html or ""))
        revisit = len(payload) >= 1000 and last != page
        row = got[page]
        assert (row.payload_bytes, row.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (row.record_type, row.refers_to) == (("revisit", last) if revisit else ("response", None))


def test_urls(spark, tables):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op2_url_aliases(spark, tables).collect()}
    assert got[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[3] == ("a.net", "/es/x", "net/es/", "block")
    assert got[4] == ("a.net", "/EN/x", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("sub.example.com", "/en/", "example.com/en/", "block")
    assert got[8] == ("notexample.com", "/en/", "com/", "allow")
    assert got[9] == ("net", "/fr/", "net/fr/", "block")


def test_shards(spark, tables):
    got = queries.op8_histogram_sharding(spark, tables).collect()
    assert sorted(r.doc_id for r in got) == [d[0] for d in DOCS]
    text = {d[0]: (d[1] or "").encode() for d in DOCS}
    for r in got:
        assert r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        assert 0 <= r.shard < 24
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_mix(spark, tables):
    got = {r.doc_id: r for r in queries.op9_weighted_mix(spark, tables).collect()}
    size = {d[0]: len((d[1] or "").split()) for d in DOCS}
    assert {k: r.size for k, r in got.items()} == size
    assert all(0 <= r.taken <= 3 * r.size for r in got.values())
    again = {r.doc_id: r.taken for r in queries.op9_weighted_mix(spark, tables).collect()}
    assert again == {k: r.taken for k, r in got.items()}
    for source in {d[3] for d in DOCS}:
        rows = [got[d[0]] for d in DOCS if d[3] == source]
        assert {r.source_size for r in rows} == {sum(r.size for r in rows)}
        assert rows[0].target <= 3 * rows[0].source_size + 1e-6
