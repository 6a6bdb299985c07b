from conftest import rows
from pyspark.sql import functions as F

from newsgraph.operators import profile as pf
from newsgraph.operators.entity import last_entity_word, ngrams, with_gate


def test_gate_truth_table(spark, gazetteer):
    texts = ["Jane Doe", "by Ann Lee, today", "Ann and Lee", "acme corp", "the Acme Corp deal", "2016-12-05 10:00:00",
             "2016-12-05", "markets", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [False, False, True, True, False, False, True, True, True, None]
    for key in (None, "i"):
        got = with_gate(df, "t", gazetteer, key=key).orderBy("i").collect()
        assert [r["is_topic"] for r in got] == want
    model = lambda c: F.contains(c, F.lit("markets"))
    got = with_gate(df, "t", model=model).orderBy("i").collect()
    assert [r["is_topic"] for r in got] == [True] * 5 + [False, True, False, True, None]


def test_ngrams(spark):
    got = spark.sql("select 'a b c' t").select(ngrams(F.col("t"))).first()[0]
    assert got == ["a", "b", "c", "a b", "b c", "a b c"]


def test_last_entity_word(spark, gazetteer):
    df = spark.createDataFrame([(1, ["Ohio", "near", "Springfield"]), (2, ["none"]), (3, [])], "k int, w array<string>")
    assert rows(last_entity_word(df, "k", "w", gazetteer)) == [(1, "Springfield")]


ENTRIES = [
    (1, 0, "email", ""), (1, 1, "email", "late@example.com"),
    (2, 0, "name", "A"), (2, 1, "email", "a@example.com"), (2, 2, "email", "b@example.com"),
    (2, 3, "Media link", "x"), (2, 4, "Media link", "y"), (2, 5, "Media link", "x"), (2, 6, "Loc", "Ohio,USA"),
    (2, 7, "bio", "Says email: c@example.com"),
    (3, 0, "name", "C"),
]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "item_id int, pos long, tag string, value string")


def test_first_email_decides(spark):
    assert {r["item_id"] for r in pf.eligible(entries(spark)).collect()} == {2}


def test_distinct_profile(spark):
    got = pf.distinct_profile(entries(spark)).where("item_id = 2").orderBy("pos").collect()
    assert [(r["tag"], r["value"]) for r in got] == [
        ("email", "a@example.com"), ("name", "A"), ("Media link", "x"), ("Media link", "y"),
        ("Loc", "Ohio,USA"), ("bio", "Says email: c@example.com"),
    ]


def test_contact_rows(spark):
    got = pf.contact_rows(entries(spark)).collect()
    assert len(got) == 1
    row = got[0].asDict()
    assert row["email"] == "a@example.com" and row["media_link"] == "y"  # duplicates count once, the last wins
    assert (row["state"], row["country"]) == ("Ohio", "USA")
    assert row["about_info"] == "Says email: c@examplecom"


def test_difference_and_append(spark):
    df = entries(spark)
    emails = df.where("tag = 'email'")
    assert pf.entries_minus(df, emails).count() == len({e[0:1] + e[2:] for e in ENTRIES if e[2] != "email"})
    assert pf.append_entries(df, emails).count() == df.count() + emails.count()
