"""Spelling variants against a comparison of all words; filters; passes."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from newsgraph.llm.spelling import LOWER, UPPER, near_words, plan_passes, spelling_variants

SCHEMA = "doc_id long, text string, word string, n int, root string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs, slip=None):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        form = others[0] if others and words[others[0]] >= 5 * n else None
        out[w] = (form, n, len(others), words.get(form))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, form, root(w), n, k, f) for w, (form, n, k, f) in out.items())


def corpus(seed):
    """Words with variants of falling counts, chains of them, doubled letters, other letters."""
    r = random.Random(seed)
    words = {}
    for base in ("abcdef", "aaaaaaaa", "mississippi", "Straßenbahn", "étéétéé", "xyzzyx÷×", "ÀÉÎõü" * 3):
        word, n = base, 700
        while n >= 3:
            words[word] = n + r.randint(0, 2)
            i = r.randrange(len(word))
            word = word[:i] + r.choice(["", r.choice("abcéß") + word[i], r.choice("xyzÿ")]) + word[i + 1:]
            n //= r.choice([2, 5, 6])
    text = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(text)
    docs = [(i, r.choice([" ", "\n", "1", "-"]).join(text[i::40])) for i in range(40)]
    return docs + [(None, "abcdefg " * 6), (None, None), (1, ""), (2, "a"), (3, "long" * 5000 + " "), (3, "long" * 5000)] + [(9, "ABCDEFH " * 5)] * 2


@pytest.mark.parametrize(("seed", "slip", "filter_bytes"), [(1, None, 24 << 20), (2, 7, 24 << 20), (3, 199, 16)])
def test_equals_brute_force(spark, seed, slip, filter_bytes):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], SCHEMA).repartition(3)
    got = spelling_variants(df, slip=slip, filter_bytes=filter_bytes).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute(docs, slip)


def test_pairs_come_once_and_long_words_too(spark):
    long = "ab" * 3000
    words = ["aabbcc", "aabbc", "abbcc", "aabbcd", "aabbccc", "aacbcc", long, long + "c", long[:-1] + "c", long[1:]]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r.word, r.other))) for r in near_words(df).collect()]
    wanted = {tuple(sorted((a, b))) for a in words for b in words if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_empty_tables(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "few words", "", 1, ""), (2, None, "", 1, "")], SCHEMA)
    assert spelling_variants(df).collect() == []


def test_filters_of_a_pass_are_bounded():
    shards, passes = plan_passes({6: 10, 7: 10_000_000, 8: 1, 9: 3_000_000}, 1 << 20)
    blocks = {6: 3, 7: 2_500_000, 8: 1, 9: 750_000}
    for one in passes:
        assert sum(one.values()) * 8 <= 1 << 20
    for size, n in blocks.items():
        parts = [b for one in passes for (s, _), b in one.items() if s == size]
        assert len(parts) == shards[size] and sum(parts) >= n * 0.99
    assert plan_passes({}, 100) == ({}, [])
