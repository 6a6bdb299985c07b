"""All queries on empty tables and on odd rows; license scan, quality base rules,
packing, token files, neighbours and the pipeline against plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsgraph.llm import queries
from newsgraph.llm.tokens import tokenizer_path

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string, lang string",
    "embeddings": "vec_id long, embedding array<float>, cluster int",
}
# columns whose names the operators use themselves
CLASH = "size int, key string, class int, n int, row int, component_id long, position int, rank int, start long"
ODD = (None, None, None, None, None, None, None, None, None)
SAID = "The tool is released under the MIT license and works. "
TEXTS = [
    "one two three four five six seven eight nine ten " * 3,
    SAID + " ".join(f"word{i}" for i in range(60)),
    SAID + " ".join(f"word{i}" for i in range(59)) + " other",
    "Apache License, Version 2.0 and cc-by-nc and CC BY NC, apache license version 2",
    None, "", " \n\t", "a", "x y z", "x y z", "b " * 40_000,
    "\n".join(["same line here"] * 5 + ["another line", "  ", "", "same line here"]),
    "l'été où # * $ % & | < > é" * 30,
    "released under the mlt license here", "  double  blanks   and\ttabs \n\n here  ",
    "😀 emoji and 　 wide space 中文 文本",
    "end <|endoftext|> start", "  <|endoftext|>  <|endoftext|><|endoftext|>\n x<|endoftext|>y ",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 2 + (i == 7)], len(t or ""), *ODD)
            for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[1], (None, "no id here", "en", "s1", 3, *ODD), (None, None, None, None, None, *ODD)]
    spark.createDataFrame(rows, f"{SCHEMAS['documents']}, {CLASH}").write.parquet(f"{path}/documents.parquet")
    pages = [(1, "http://a.net/es/", None, None), (2, None, "", "x"), (3, "http://b.com", "é" * 900, None),
             (4, "http://b.com", "é" * 900, None), (4, "http://b.com", "é" * 900, None), (5, None, "é" * 900, None)]
    spark.createDataFrame([(*p, *ODD) for p in pages], f"{SCHEMAS['pages']}, {CLASH}").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).tolist(), i) for i in range(300)]
    vectors += [(300, None, 0), (350, [0.0] * 8, 0), (400, [math.nan] + [1.0] * 7, 0), (450, [None] + [1.0] * 7, None),
                (500, vectors[0][1], 1), (501, vectors[0][1], 1)]
    spark.createDataFrame([(*v, *ODD) for v in vectors], f"{SCHEMAS['embeddings']}, {CLASH}").write.parquet(
        f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def documents(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet").collect()


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_quality_outliers", "op8_histogram_sharding",
                                  "op9_weighted_mix", "op10_jaccard_join", "op5_token_files"])
def test_every_row_comes_back(spark, odd, name):
    got = Counter(r.doc_id for r in queries.QUERIES[name](spark, odd).collect())
    assert got == Counter(d.doc_id for d in documents(spark, odd))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_license_scan(spark, odd):
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, odd).collect()}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        places = [(k, label) for phrase, label in phrases.items() for k in range(len(words))
                  if words[k:k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (
            len(words), len(at), min(at, default=None), max(at, default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1
    assert (got[13].base_labels, got[13].labels) == ("", "mit")  # one edit
    assert got[0].labels == got[10].labels == ""


def test_quality_base_columns(spark, odd):
    got = {r.doc_id: r for r in queries.op3_quality_outliers(spark, odd).collect()}
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        seen = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        row = got[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered)), i
        assert row.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (row.base_failed and row.kept)


def token_ids(texts, end):
    library = Tokenizer.from_file(tokenizer_path(queries.TOKENIZER))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_token_files(spark, odd):
    docs = documents(spark, odd)
    wanted = Counter((d.doc_id, ids.size, zlib.crc32(ids.tobytes()))
                     for d, ids in zip(docs, token_ids([d.text for d in docs], 2), strict=True))
    got = queries.op5_token_files(spark, odd).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == wanted
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_packing(spark, odd):
    docs = documents(spark, odd)
    texts = dict(zip([d.doc_id for d in docs], token_ids([d.text for d in docs], 0), strict=True))
    got = queries.op4_curve_packing(spark, odd).collect()
    assert sum(r.length for r in got) == sum(t.size for t in token_ids([d.text for d in docs], 0))
    for r in got:
        if r.doc_id is not None:
            part = texts[r.doc_id][r.start:r.start + r.length]
            assert (r.length, r.ids_crc32, r.doc_tokens) == (part.size, zlib.crc32(part.tobytes()), texts[r.doc_id].size)
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = Counter()
    for sequence, offset, length in at:
        assert ends[sequence] == offset
        ends[sequence] += length
    assert all(ends[s] == 1024 for s in range(max(ends))) and ends[max(ends)] <= 1024


def test_nearest_neighbours(spark, odd):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows
               if r.embedding is not None and None not in r.embedding
               and np.isfinite(r.embedding).all() and any(r.embedding)}
    ids = np.array(sorted(vectors))
    unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    got: dict[int, list] = {}
    for r in queries.op7_nn_descent(spark, odd).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == [int(i) for i in ids if i % 50 == 0]
    hits = 0
    for query, found in got.items():
        cosine = dict(zip(ids.tolist(), (unit @ (vectors[query] / np.linalg.norm(vectors[query]))).tolist(), strict=True))
        best = sorted((i for i in cosine if i != query), key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and query not in {r.vec_id for r in found}
        assert all(abs(r.score - cosine[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len(set(best) & {r.vec_id for r in found})
    assert hits >= 0.9 * 5 * len(got)


def test_pipeline(spark, odd):
    import corpus_pipeline

    kept = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd)
    judged = queries.op3_quality_outliers(spark, odd).where("kept").collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged)
    apart = corpus_pipeline.near_duplicate_groups(spark, kept, odd)
    left = [r.doc_id for r in apart.collect()]
    assert 1 in left and 2 not in left and len(left) == len(set(left))
    mixed = corpus_pipeline.source_mix(spark, apart, odd)
    assert mixed.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(left)
    pieces = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in pieces} <= set(left) and all(r.length <= 1024 for r in pieces)
