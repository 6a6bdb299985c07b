"""The source divergence audit against plain Python with exact integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from newsgraph.llm import divergence
from newsgraph.llm.divergence import _p, share, sort_pointers, source_divergence
from pyspark.sql import functions as F

SCHEMA = "lang string, source string, text string, n int, term string, V int, doc_id long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    count, frequency = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang or "", source or ""].update(words)
        frequency[lang or ""].update(set(words))
    out = []
    for lang in frequency:
        kept = [t for t, n in frequency[lang].items() if n >= 3]
        groups = {s: c for (x, s), c in count.items() if x == lang}
        groups[None] = sum(groups.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept} for s, c in groups.items()}
        q = p.pop(None)
        for s in p:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in p if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = [f"{r.choice('aäb')}{r.choice(['', 'longer', 'verymuchlonger', 'verymuchlongerstill'])}{chr(97 + i % 26)}" for i in range(60)] + ["ß", "日本", "A", "aB"]
    rows = []
    for _ in range(120):
        weights = [r.random() ** 4 for _ in words]
        text = "".join(w + r.choice([" ", "\n", "1", "_", "-"]) for w in r.choices(words, weights, k=r.choice([0, 1, 30, 200])))
        rows.append((r.choice(["en", "de", None]), r.choice(["s1"] * 5 + ["s2", "s3", "", None]), r.choice([text, text, None, ""])))
    rows += [("xx", "alone", "one two one two"), ("yy", "a", "rare words"), ("yy", "b", None), ("en", "s2", "a " * 20_000), ("en", "s2", "Z" * 5000)]
    return rows + rows[:10]


@pytest.mark.parametrize(("seed", "size"), [(1, 6 << 20), (2, 500)])
def test_equals_brute_force(spark, seed, size):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "x", 2, i) for i, x in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in source_divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows)
    assert sorted(map(tuple, source_divergence(df, top_terms=4).collect())) == brute(rows, 4)


def test_empty_and_termless_tables(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("en", "a", "", 1, "", 1, 1), ("en", "b", "12", 1, "", 1, 2), ("en", None, None, 1, "", 1, 3)], SCHEMA)
    got = sorted(map(tuple, source_divergence(df).collect()))
    assert got == brute([("en", "a", ""), ("en", "b", "12"), ("en", None, None)]) and {g[4] for g in got} == {0}


def test_slices_and_blocks_of_sources(spark, monkeypatch):
    """Slices of few bytes and terms of many sources give the same."""
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = [("en", f"s{i % 40}", f"common word{i % 7} other{i % 3}") for i in range(200)]
    df = spark.createDataFrame([(*x, 1, "x", 2, 1) for x in rows], SCHEMA)
    assert sorted(map(tuple, source_divergence(df).collect())) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), max_size=40))
def test_pointers_are_sorted(words):
    text = " ".join(words).encode()
    buffer = np.zeros(len(text) + 8, np.uint8)
    buffer[:len(text)] = np.frombuffer(text, np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size + 1) - size - 1
    order, first = sort_pointers(buffer, start, size)
    assert [words[i] for i in order] == sorted(words)
    assert [words[i] for i in order[first]] == sorted(set(words))


def test_shares_are_exact(spark):
    cases = [(0, 1), (5, 7), (10**12, 10**12 + 3), (123456789012, 9 * 10**14), (9 * 10**14, 9 * 10**15)]
    wanted = [1 + 10**9 * (c + 1) // t for c, t in cases]
    got = spark.createDataFrame(cases, "c long, t long").select(share(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == wanted
    assert _p(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == wanted
