"""Spans of personal data against plain Python, checksums, context, and hostile texts."""

from __future__ import annotations

import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from newsgraph.llm.personal_data import ADDED, BASE, IBAN_LENGTHS, Kind, personal_data, span_digest

SCHEMA = "doc_id long, text string, spans string, kind int, found_ip int"


def luhn(digits):
    twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(twice) % 10 == 0


def base(text):
    """The contract's patterns as they are written."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def iban(country, account):
    """An account number with right check digits."""
    turned = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{account}"


DE = iban("DE", "370400440532013000")
TEXTS = [
    None, "", "nothing here", "a@b.c", "x a.b+c@d-e.f.g, y", "a@b.com%c@d.org", "a@b@c.d", "@b.c a@ a@b", "a@b.c.", "é@b.cé x@ü.de",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255", "0001.0000255.00.1", "1.2.3 . 4", "9" * 400 + ".1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111112", "0000000000000000", "41111111111111110 4111 1111 1111 1111",
    "6011000990139424 1", "+1 (555) 123-4567", "+12", "+1234567", "+12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49 30 1234567)", "+4-.(",
    "card 4111111111111111 mail a@b.co ip 10.0.0.1 tel +49 30 123456", "中文 a@b.co 😀 10.0.0.1 é +49 30 123456",
    "a@b.co" * 600, "1.1.1.1 " * 700, "4111111111111111\n" * 300,
]


def by_text(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id: r for r in span_digest(personal_data(df, **options)).collect()}


def assert_base(row, text):
    spans = base(text)
    named = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone"))
    assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
    assert row.spans.startswith(named) and len(row.scores.split(",")) == len(row.spans.split(","))


def test_base_kinds(spark):
    got = by_text(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        assert_base(got[i], text)


PARTS = ["a", "b.c", "@", "1", "22", "255", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "_", "%", "\n", "DE89"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=150, max_size=150))
def test_any_mix(spark, texts):
    got = by_text(spark, texts)
    for i, text in enumerate(texts):
        assert_base(got[i], text)


@pytest.mark.parametrize(("text", "spans"), [
    (DE, f"iban:0:{len(DE)}"),
    ("pay to " + " ".join(DE[i:i + 4] for i in range(0, 22, 4)) + " today", "iban:7:34"),
    (DE[:-1] + str((int(DE[-1]) + 1) % 10), ""), ("x" + DE, ""), (DE + "5", ""), (iban("XX", "370400440532013000"), ""),
    ("my ssn is 123-45-6789.", "ssn:10:21"), ("part 123-45-6789", ""), ("123-45-6789", ""), ("ssn 000-45-6789 ssn 123-00-6789 ssn 123-45-0000", ""),
    ("ssn 1123-45-6789 ssn 123-45-67890", ""),
])
def test_added_kinds(spark, text, spans):
    row = by_text(spark, [text])[0]
    added = [x for x in row.spans.split(",") if x.startswith(("iban", "ssn"))]
    assert ",".join(added) == spans
    assert_base(row, text)


def test_every_country(spark):
    texts = [iban(c, "1" * (n - 4)) for c, n in IBAN_LENGTHS.items()]
    got = by_text(spark, texts)
    assert all(got[i].n_iban == 1 for i in range(len(texts)))


def test_context_moves_the_score(spark):
    got = by_text(spark, ["10.0.0.1", "server 10.0.0.1", "version 10.0.0.1", "observer 10.0.0.1", "a@x.co", "email a@x.co", "test a@x.co",
                          "server " + "x" * 60 + " 10.0.0.1"])
    assert [got[i].scores for i in range(8)] == ["60", "90", "20", "60", "90", "100", "70", "60"]


def test_own_kinds_and_texts(spark):
    order = Kind("order", "ORD-[0-9]{6}", lambda text, before, after: ~after.rlike("^[0-9]"), 50, ("order",), 20, least=60)
    df = spark.createDataFrame([(1, "your order ORD-123456, ORD-1234567"), (None, "ORD-111111"), (1, "your order ORD-123456, ORD-1234567")], "doc_id long, text string")
    rows = sorted(personal_data(df, [order]).collect(), key=str)
    assert [len(r.spans) for r in rows] == [1, 1, 0]
    assert rows[0].spans[0].asDict() == {"kind": "order", "start": 11, "end": 21, "text": "ORD-123456", "score": 70}


def test_hostile_texts_take_linear_time(spark):
    """Long runs that a pattern can begin in at every place."""
    texts = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "a@b." * 75_000,
             "+1" + "(" * 300_000, "AB12" * 75_000, "12-" * 100_000]
    started = time.time()
    got = by_text(spark, texts)
    assert time.time() - started < 60 and len(got) == len(texts)
    assert_base(got[2], texts[2])
    assert_base(got[6], texts[6])


def test_no_python_in_the_plan(spark):
    plan = span_digest(personal_data(spark.createDataFrame([(1, "x")], "doc_id long, text string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert span_digest(personal_data(spark.createDataFrame([], SCHEMA))).collect() == []
    assert [k.name for k in BASE + ADDED] == ["email", "ip", "card", "phone", "iban", "ssn"]
