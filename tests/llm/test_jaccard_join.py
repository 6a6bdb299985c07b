"""The Jaccard join against a comparison of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from newsgraph.llm import jaccard_join
from newsgraph.llm.jaccard_join import near_duplicates, plan_bands

SCHEMA = "doc_id long, text string, lang string, class string, sig long"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(docs, width, threshold):
    sets = [(d, shingles(t, width)) for d, t in docs]
    label = list(range(len(docs)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    least = {}
    for (d, _), z in zip(docs, label, strict=True):
        least[z] = d if least.get(z) is None else min(least[z], d)
    return sorted((d, len(s), least[z]) for (d, s), z in zip(sets, label, strict=True))


def corpus(seed):
    """Groups of near copies around the threshold, small texts, blanks and copies."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "One", "one", "ONE two", "a b c", "a  b\nC"]
    for base_size in (12, 25, 60, 150):
        base = r.choices(words, k=base_size)
        for _ in range(18):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts += [" ".join(copy)] * r.choice((1, 1, 2))
    texts += [" ".join(r.choices(words, k=r.randint(1, 80))) for _ in range(20)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "threshold", "block", "deletions"), [
    (3, 90, 512, False), (3, 90, 2, True), (5, 80, 4, False), (5, 80, 512, True), (3, 90, 3, None), (5, 80, 1, None)])
def test_equals_brute_force(spark, width, threshold, block, deletions):
    docs = corpus(width * threshold + block)
    df = spark.createDataFrame([(d, t, "en", "x", 1) for d, t in docs], SCHEMA).repartition(3)
    plan = None if deletions is None else dict.fromkeys(range(20), deletions)
    got = near_duplicates(df, width, threshold, plan=plan, block=block)
    assert sorted(map(tuple, got.collect())) == brute(docs, width, threshold)


def chained(seed, copies):
    """One large group: copies of a text with 0 to 8 of a few edits each, so that
    pairs lie on both sides of the threshold, and copies of copies."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(copies):
        copy = list(base)
        for at in r.sample(range(0, 120, 6), r.randint(0, 8)):
            copy[at] = f"x{at}"
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize(("block", "deletions"), [(16, False), (512, None), (7, True)])
def test_large_group_around_the_threshold(spark, block, deletions):
    docs = chained(block, 150)
    df = spark.createDataFrame([(d, t, "en", "x", 1) for d, t in docs], SCHEMA)
    plan = None if deletions is None else dict.fromkeys(range(20), deletions)
    got = sorted(map(tuple, near_duplicates(df, 3, 90, plan=plan, block=block).collect()))
    assert got == brute(docs, 3, 90)
    assert 1 < len({g[2] for g in got}) < 150


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "a b c d e f", "en", "x", 1)] * 2 + [(2, "A b c d e f", None, None, None), (None, None, None, None, None),
                                                     (7, long, "en", "x", 1), (9, long + " end", "en", "x", 1)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [g[0::2] for g in got] == [(1, 1), (1, 1), (2, 1), (7, 7), (9, 7), (None, None)]


def planned(spark, docs):
    source = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [(i, d, len(shingles(t, 3))) for i, (d, t) in enumerate(docs)]
    return plan_bands(source, spark.createDataFrame(rows, "class long, doc_id long, n long"), 3, 90)


def test_deletions_are_planned_where_plain_segments_collide(spark):
    """Texts with the same beginning agree on one of two segments, but differ in more than one token."""
    r = random.Random(1)
    same = "a b c d e f g h i j k l"
    assert planned(spark, [(i, f"{same} {r.random()} {r.random()}") for i in range(300)])[0]
    other = [(i, " ".join(str(r.random()) for _ in range(13))) for i in range(300)]
    assert planned(spark, other) == {0: False}


def test_shared_rows_come_out_of_one_exchange(spark):
    """The rows of shared keys, whole, without a second pass over the index."""
    rows = [(1, 10, True, 0, 9), (1, 11, False, 0, 9), (2, 10, True, 1, 9), (2, 10, True, 1, 9), (3, 12, False, 2, 9), (3, 13, False, 2, 9)]
    df = spark.createDataFrame(rows, "sig long, class long, own boolean, segment int, n long")
    got = jaccard_join._shared(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == rows[:2]


def test_sketches_let_every_linked_pair_through():
    r = random.Random(7)
    base = np.array(sorted(r.getrandbits(64) for _ in range(400)), np.uint64)
    sketch = lambda s: np.bincount((s >> np.uint64(40)).astype(np.int64) % jaccard_join.SKETCH, minlength=jaccard_join.SKETCH).astype(np.uint8).tobytes()
    other = np.array([r.getrandbits(64) for _ in range(400)], np.uint64)
    sets = [np.concatenate([base[k:], other[:k]]) for k in (0, 20, 44, 400)]
    batch = pa.RecordBatch.from_pydict({
        "a": [0] * 4, "b": [0, 1, 2, 3], "most": [20 * 800 // 180] * 4,
        "sketch_a": [sketch(base)] * 4, "sketch_b": [sketch(s) for s in sets]})
    assert next(jaccard_join._alike([batch])).column("b").to_pylist() == [0, 1, 2]
