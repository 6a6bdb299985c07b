"""Recall of the neighbour search with clumps of near copies; mixed lengths; large components."""

from __future__ import annotations

import numpy as np
import pytest

from newsgraph.llm.nn_descent import nearest_neighbours


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, vectors, strict=True)],
                                 "vec_id long, embedding array<double>")


@pytest.mark.parametrize("noise", [1e-2, 1e-3, 1e-5])
def test_recall_with_a_clump_of_near_copies(spark, noise):
    """A third of the rows and more are near copies; ties in the last digits are forgiven."""
    rng = np.random.default_rng(int(-np.log10(noise)))
    x = np.concatenate([rng.normal(size=(1000, 32)), rng.normal(size=(1, 32)) + noise * rng.normal(size=(1500, 32))])
    x = x[rng.permutation(len(x))]
    got: dict[int, list] = {}
    for r in nearest_neighbours(frame(spark, x)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert sorted(got) == list(range(0, len(x), 50))
    for query, found in got.items():
        distance = ((unit - unit[query]) ** 2).sum(1)
        distance[query] = np.inf
        fifth = np.sort(distance)[4]
        hits += sum(distance[v] <= fifth * (1 + 1e-6) for _, v, _ in found)
        cosine = unit @ unit[query]
        assert all(abs(s - cosine[v]) < 1e-12 for _, v, s in found)
    assert hits >= 0.9 * 5 * len(got)


def test_commonest_length_stays(spark):
    rng = np.random.default_rng(1)
    vectors = [[1.0, 2.0]] + list(rng.normal(size=(200, 8)))
    got = nearest_neighbours(frame(spark, vectors)).collect()
    assert {r.query_id for r in got} == {50, 100, 150, 200} and 0 not in {r.vec_id for r in got}


def test_large_and_small_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(101, 4))
    scale = np.array([1e200 if i % 3 == 0 else 1e-200 if i % 3 == 1 else 1.0 for i in range(101)])
    plain = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest_neighbours(frame(spark, x)).collect()}
    for r in nearest_neighbours(frame(spark, x * scale[:, None])).collect():
        vec, score = plain[r.query_id, r["rank"]]
        assert r.vec_id == vec and abs(r.score - score) < 1e-9
