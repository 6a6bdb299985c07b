"""Spelling variants: generated edits probed against Bloom filters, positives joined exactly.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. Each unordered pair is generated once: the longer word by its
deletions, words of equal length by replacements with a larger code point. Word
hashes are sums of hashes of (code point, position), so the hash of an edit comes
from that of its word by a subtraction and an addition, in numpy for all words
of a length at once. Edits are looked up in blocked Bloom filters, one per word
length; one lookup reads one 64-bit block. Only positives become strings and
shuffle to a join with the vocabulary, which removes the false ones.

All filters of a pass are broadcast and take ``FILTER_BYTES`` at most. A
vocabulary that needs more is sharded by length, and lengths by hash, into
several passes; so the broadcast never grows with the data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.llm.common import Written, written
from newsgraph.llm.shingles import mix

#: Bits of filter per word, and the most bytes of all filters of one pass.
WORD_BITS, FILTER_BYTES = 16, 24 << 20
#: Words whose edits are generated together.
CHUNK = 8192
#: Code points of words: the letters kept by lower-casing A-Z only.
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def counted_words(docs: DataFrame, least_length: int, least_count: int, slip: int | None, id_column: str,
                  text_column: str) -> DataFrame:
    """(word, n): the runs of letters of all texts and how often they occur.

    ``slip``: where this divides the crc32 of ``<id>:<run>``, the run loses the
    code point at that number modulo its length. A null id counts as empty.
    """
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        # shorter runs cannot become words: deleting only shortens them
        F.explode(F.regexp_extract_all(F.col(text_column).cast("string"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"),
    ).select("id", lower_ascii(F.col("run")).alias("word"))
    if slip:
        at = F.pmod("_crc", F.length("word")).cast("int")
        runs = runs.withColumn("_crc", F.crc32(F.concat_ws(":", "id", "word"))).withColumn(
            "word", F.when(F.col("_crc") % slip == 0, F.concat(
                F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))).otherwise(F.col("word")))
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least_count)


def _value(codes, places: np.ndarray) -> np.ndarray:
    """A hash of each code point at its place."""
    return mix(codes.astype(np.uint64) + (places << np.uint64(32)))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, code point matrix) for the words of each length, in chunks."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        for at in range(0, every.size, max(1, CHUNK * 16 // int(size))):
            rows = every[at:at + max(1, CHUNK * 16 // int(size))]
            codes = np.array([words[i] for i in rows], f"<U{size}").view(np.uint32).reshape(-1, size)
            yield int(size), rows, codes


def _place(total: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, mask): where a hash falls in a filter of so many 64-bit blocks, and its four bits there."""
    h = mix(total, 1)
    one = np.uint64(1)
    mask = np.zeros(h.shape, np.uint64)
    for i in range(4):
        mask |= one << (h >> np.uint64(6 * i) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), mask


def _slice(total: np.ndarray, slices: int) -> np.ndarray:
    return (mix(total, 2) % np.uint64(slices)).astype(np.int64)


def _filter_rows(batches, shards: dict[int, int], blocks: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """(length, slice, block, mask) of every word of the pass."""
    for batch in batches:
        for size, _, codes in _by_length(batch.column("word").to_pylist()):
            total = _value(codes, np.arange(size, dtype=np.uint64)).sum(1)
            part = _slice(total, shards[size])
            for s in range(shards[size]):
                if (size, s) in blocks and (own := total[part == s]).size:
                    block, mask = _place(own, blocks[size, s])
                    n = block.size
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(block),
                        pa.array(mask.view(np.int64))], ["length", "slice", "block", "mask"])


def _found(total: np.ndarray, size: int, shards: dict[int, int], filters: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Positions of the hashes that a filter of the pass has."""
    out = []
    for s in range(shards.get(size, 0)):
        bits = filters.get((size, s))
        if bits is None:
            continue
        own = np.flatnonzero(_slice(total, shards[size]) == s) if shards[size] > 1 else None
        block, mask = _place(total if own is None else total[own], bits.size)
        hit = np.flatnonzero(bits[block] & mask == mask)
        out.append(hit if own is None else own[hit])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _edits(batches, shards: dict[int, int], counts: dict[int, int], alphabet: list[int], shared) -> Iterator[pa.RecordBatch]:
    """(word, n, edit): the edits of each word that pass a filter."""
    filters = shared.value
    letters = np.array(sorted(alphabet), np.uint32)
    for batch in batches:
        for size, rows, codes in _by_length(batch.column("word").to_pylist()):
            at, edits = [], []
            places = np.arange(size, dtype=np.uint64)
            values = _value(codes, places)
            if counts.get(size, 0) > 1 and any(length == size for length, _ in filters):
                rest = (values.sum(1)[:, None] - values).reshape(-1)
                for x in letters:
                    spot = np.flatnonzero(codes.reshape(-1) < x)  # a pair is generated from its smaller side
                    hit = spot[_found(rest[spot] + _value(x, places)[spot % size], size, shards, filters)]
                    if hit.size:
                        new = codes[hit // size]
                        new[np.arange(hit.size), hit % size] = x
                        at.append(rows[hit // size])
                        edits += new.view(f"<U{size}").reshape(-1).tolist()
            if any(length == size - 1 for length, _ in filters):
                moved = _value(codes, places - np.uint64(1))  # as if one place to the left; the first never is
                moved[:, 0] = 0
                without = np.cumsum(values, 1) - values + np.cumsum(moved[:, ::-1], 1)[:, ::-1] - moved
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours only the first is deleted
                spot = np.flatnonzero(first)
                hit = spot[_found(without.reshape(-1)[spot], size - 1, shards, filters)]
                if hit.size:
                    new = codes[hit // size][np.arange(size) != (hit % size)[:, None]].reshape(-1, size - 1)
                    at.append(rows[hit // size])
                    edits += new.view(f"<U{size - 1}").reshape(-1).tolist()
            if at:
                taken = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(taken), batch.column("n").take(taken), pa.array(edits, pa.string())],
                    ["word", "n", "edit"])


def plan_passes(counts: dict[int, int], filter_bytes: int) -> tuple[dict[int, int], list[dict[tuple[int, int], int]]]:
    """(slices per length, passes); a pass maps (length, slice) to 64-bit blocks, together ``filter_bytes`` at most."""
    shards, passes, room = {}, [], 0
    for size, words in sorted(counts.items()):
        blocks = -(-words * WORD_BITS // 64)
        shards[size] = -(-blocks * 8 // filter_bytes)
        for s in range(shards[size]):
            need = max(1, -(-blocks // shards[size]))
            if need * 8 > room:
                passes.append({})
                room = filter_bytes
            passes[-1][size, s] = min(need, max(1, filter_bytes // 8))
            room -= need * 8
    return shards, passes


def near_words(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): each unordered pair of near words of (word, n) once.

    ``vocabulary`` has distinct words without nulls; the words at one code point
    from the empty one find nothing there. It is read several times, so it
    should be a written table.
    """
    spark = vocabulary.sparkSession
    counts = {r["length"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().collect()}
    alphabet = [ord(r["x"]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct().collect()]
    shards, passes = plan_passes(counts, filter_bytes)
    positives: list[DataFrame] = []
    for blocks in passes:
        rows = vocabulary.where(F.length("word").isin(sorted({size for size, _ in blocks}))).select("word").mapInArrow(
            partial(_filter_rows, shards=shards, blocks=blocks), "length int, slice int, block long, mask long")
        bits = rows.groupBy("length", "slice", "block").agg(F.bit_or("mask").alias("mask")).toPandas()
        filters = {key: np.zeros(n, np.uint64) for key, n in blocks.items()}
        for key, own in bits.groupby(["length", "slice"]):
            filters[key][own["block"].to_numpy()] = own["mask"].to_numpy().view(np.uint64)
        reached = sorted({size + more for size, _ in blocks for more in (0, 1)})
        positives.append(vocabulary.where(F.length("word").isin(reached)).select("word", "n").mapInArrow(
            partial(_edits, shards=shards, counts=counts, alphabet=alphabet, shared=spark.sparkContext.broadcast(filters)),
            "word string, n long, edit string"))
    if not positives:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    every = positives[0]
    for one in positives[1:]:
        every = every.unionByName(one)
    return every.withColumnRenamed("edit", "other").join(known, "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), following forms to the last. Each step
    doubles the reach; counts grow along a chain, so there is no cycle."""
    now = Written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.df.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = Written(now.df.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now.drop()
        now = step
        if step.df.where("moved").isEmpty():
            return step.df.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, slip: int | None = None,
                      filter_bytes: int = FILTER_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the whole texts.

    Words are maximal runs of letters (A-Z read as a-z) of ``least_length`` code
    points with ``least_count`` occurrences or more. A word's form is its near
    word of largest n (ties: the smallest in code point order), if that is at
    least ``ratio`` times its own; the root is the last of a chain of forms, a
    word without a form is its own. Null and empty texts have no word, rows
    repeated count each time, texts of any length are read whole; without words
    the result is empty. Other columns are ignored. ``slip``: see ``counted_words``.
    """
    vocabulary = written(counted_words(docs, least_length, least_count, slip, id_column, text_column), "vocabulary")
    pairs = written(near_words(vocabulary, filter_bytes), "near")
    links = pairs.select("word", "n", "other", "other_n").union(pairs.select("other", "other_n", "word", "n"))
    # a word has at most (2 * length + 1) * alphabet near words
    best = links.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    judged = vocabulary.join(best, "word", "left")
    strong = -F.col("best.rank") >= F.col("n") * ratio
    judged = written(judged.select(
        "word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, -F.col("best.rank")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
