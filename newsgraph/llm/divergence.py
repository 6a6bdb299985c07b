"""Source divergence audit: sorted token-start pointers give frequencies, sources are held against each other.

Inside a task the texts stay in their Arrow buffers. Every token start is a
pointer; the pointers of a slice of whole documents are sorted by multikey
quicksort, whose characters are eight bytes of the buffer: all pointers are
sorted by the first character, runs of equal ones that go on by the next, and
so forth, in numpy. Runs that stay equal are the terms of the slice; their
lengths and the documents in them give the occurrences per source and the
document frequency. Spark adds up the slices.

For two sources of a language the divergence is a sum over all kept terms, of
which most are absent from one of the two or both. What absent counts give is
the same for all such terms, so only the terms that occur are touched: sums over
the distinct counts of each source, and corrections for terms that occur in both.
The (source, source) sums are added up inside tasks, no pair of rows is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.llm.common import written

#: Bytes of text whose pointers are sorted together; a longer document is a slice of its own.
SLICE_BYTES = 6 << 20
#: Partial sums a task holds before it hands them on, and values computed at once.
HELD, AT_ONCE = 1 << 18, 1 << 21
SCALE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(ord("a"), ord("z") + 1):
    _LETTER[_c] = _LETTER[_c - 32] = True
    _LOWER[_c - 32] = _c
#: Masks that keep the first n bytes of a character of eight.
_KEEP = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)


def _characters(text: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as a number, zero beyond the token.
    ``text`` has eight bytes more than its tokens."""
    window = np.lib.stride_tricks.as_strided(text, (text.size - 7, 8), (1, 1))
    return window[start].view(">u8").reshape(-1).astype(np.uint64) & _KEEP[np.clip(left, 0, 8)]


def sort_pointers(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the pointers in order of their tokens, and where a token
    differs from the one before it."""
    key = _characters(text, start, size)
    order = np.argsort(key)
    key = key[order]
    first = np.ones(order.size, bool)
    first[1:] = key[1:] != key[:-1]
    slot = np.arange(order.size)
    depth = 8
    while slot.size:
        run = np.cumsum(first[slot])
        longer = size[order[slot]] > depth
        open_runs = np.zeros(int(run[-1]) + 1, bool)
        open_runs[run[longer]] = True
        slot = slot[open_runs[run]]
        if not slot.size:
            break
        own, run = order[slot], np.cumsum(first[slot])
        key = _characters(text, np.minimum(start[own] + depth, text.size - 8), size[own] - depth)
        turn = np.lexsort((key, run))
        order[slot] = own[turn]
        key = key[turn]
        first[slot[1:]] |= key[1:] != key[:-1]
        depth += 8
    return order, first


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls; offsets index the bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with ``SLICE_BYTES`` of text at most, or of one row."""
    at = 0
    ends = _buffers(batch.column("text"))[0][1:] if batch.num_rows else np.empty(0)
    while at < batch.num_rows:
        begin = ends[at - 1] if at else _buffers(batch.column("text"))[0][0]
        end = max(at + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _gathered(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings at the pointers, as one Arrow array."""
    offsets = np.zeros(start.size + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(start.size, pa.py_buffer(offsets), pa.py_buffer(text[at]))


def _terms(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) per slice: occurrences and documents."""
    for batch in batches:
        for part in _slices(batch):
            bounds, raw = _buffers(part.column("text"))
            raw, bounds = raw[bounds[0]:bounds[-1]], bounds - bounds[0]
            text = np.zeros(raw.size + 8, np.uint8)
            text[:-8] = _LOWER[raw]
            inside = _LETTER[raw]
            edge = np.zeros(raw.size + 1, bool)  # where a document begins
            edge[bounds] = True
            start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
            size = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1 - start
            if not start.size:
                continue
            groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
            names, group = np.unique(np.array([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in groups.to_pylist()], object), return_inverse=True)
            member = np.zeros(len(names), np.int64)
            member[group] = np.arange(group.size)  # one document of each group
            rank = np.empty(group.size, np.int64)  # documents in order of their groups
            rank[np.argsort(group, kind="stable")] = np.arange(group.size)
            group_of = np.sort(group)
            document = rank[np.searchsorted(bounds[1:], start, "right")]
            order, first = sort_pointers(text, start, size)
            run = np.cumsum(first) - 1
            pair, count = np.unique(run * group.size + document[order], return_counts=True)
            pair_run, pair_group = pair // group.size, group_of[pair % group.size]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(pair_run) != 0) | (np.diff(pair_group) != 0))))
            head = order[np.flatnonzero(first)][pair_run[new]]
            whose = pa.array(member[pair_group[new]])
            yield pa.RecordBatch.from_arrays([
                part.column("lang").take(whose), part.column("source").take(whose),
                _gathered(text, start[head], size[head]).cast(pa.string()),
                pa.array(np.add.reduceat(count, new)), pa.array(np.diff(np.append(new, pair.size)))],
                ["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, n, by) of the terms in ``least_docs`` documents of a
    language or more; ``by`` has (source, n) of each source with the term."""
    rows = docs.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
    return (
        rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term").agg(
            F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
        .where(F.col("docs") >= least_docs).select("lang", "term", "n", "by")
    )


def share(count: Column, total: Column) -> Column:
    """p of a count: 1 + floor(10^9 (count + 1) / total), exactly."""
    return F.call_function(
        "div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)")) + 1


def _p(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` in int64, by long division in steps of a thousand; totals up to 9 * 10^15."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sums:
    """Sums per (language, source, source), handed on when there are many."""

    def __init__(self):
        self.keys, self.values, self.held = [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys.append(keys[new])
        self.values.append(np.add.reduceat(values, new))
        self.held += new.size

    def rows(self, groups: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, values = np.concatenate(self.keys), np.concatenate(self.values)
            self.__init__()
            self.add(keys, values)
            keys, values = self.keys[0], self.values[0]
            self.__init__()
            a, b = keys // len(groups), keys % len(groups)
            yield pa.RecordBatch.from_arrays([
                pa.array([groups[i][0] for i in a], pa.string()), pa.array([groups[i][1] for i in a], pa.string()),
                pa.array([groups[i][1] for i in b], pa.string()), pa.array(values)], ["lang", "source", "item", "value"])


def _both(batches, groups: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms that occur in both sources: the true value less the
    ones that count one of the two as absent, plus the one that counts both so."""
    number = {(lang, source): i for i, (lang, source, _) in enumerate(groups)}
    totals = np.array([t for _, _, t in groups], np.int64)
    sums = _Sums()
    for batch in batches:
        by = batch.column("by")
        sizes = np.array([len(x) for x in by], np.int64)
        if not sizes.size:
            continue
        flat = by.flatten()
        langs = np.repeat(np.array(batch.column("lang").to_pylist(), object), sizes)
        who = np.array([number[x] for x in zip(langs, flat.field("source").to_pylist(), strict=True)], np.int64)
        count = flat.field("n").to_numpy()
        p, absent = _p(count, totals[who]), _p(np.zeros_like(count), totals[who])
        begin = np.cumsum(sizes) - sizes
        for k in np.unique(sizes):
            terms = np.flatnonzero(sizes == k)
            if k < 2:
                continue
            # sources of a term in blocks, so that a term of very many sources stays bounded
            side = min(int(k), 1024)
            step = max(1, AT_ONCE // (side * side))
            for at in range(0, terms.size, step):
                rows = begin[terms[at:at + step]][:, None]
                for i in range(0, int(k), side):
                    left = (rows + np.arange(i, min(i + side, k)))[:, :, None]
                    for j in range(0, int(k), side):
                        right = (rows + np.arange(j, min(j + side, k)))[:, None, :]
                        value = _f(p[left], p[right]) - _f(p[left], absent[right]) - _f(absent[left], p[right]) + _f(absent[left], absent[right])
                        keys = who[left] * len(groups) + who[right]
                        other = keys // len(groups) != keys % len(groups)
                        if other.any():
                            sums.add(keys[other], value[other])
                        if sums.held > HELD:
                            yield from sums.rows(groups)
    yield from sums.rows(groups)


def _one(batches, groups: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    """Per distinct count of a source, and each other source of its language:
    what the terms with that count add if the other source lacks them, beyond
    terms that both lack; in both directions."""
    langs: dict[str, list[int]] = {}
    for i, (lang, _, _) in enumerate(groups):
        langs.setdefault(lang, []).append(i)
    number = {(lang, source): i for i, (lang, source, _) in enumerate(groups)}
    totals = np.array([t for _, _, t in groups], np.int64)
    absent = _p(np.zeros_like(totals), totals)
    sums = _Sums()
    for batch in batches:
        for lang, source, count, terms in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n", "terms")), strict=True):
            own = number[lang, source]
            others = np.array([i for i in langs[lang] if i != own], np.int64)
            if not others.size:
                continue
            p, a, b = int(_p(np.array([count]), totals[own:own + 1])[0]), absent[own], absent[others]
            sums.add(own * len(groups) + others, terms * (_f(p, b) - _f(a, b)))
            sums.add(others * len(groups) + own, terms * (_f(b, p) - _f(b, a)))
            if sums.held > HELD:
                yield from sums.rows(groups)
    yield from sums.rows(groups)


def source_divergence(docs: DataFrame, least_docs: int = 3, top_terms: int = 200, lang_column: str = "lang",
                      source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) per source of a language.

    Terms are runs of letters and of characters beyond ASCII, A-Z read as a-z; a
    language keeps those in ``least_docs`` of its documents or more. Part
    ``pair`` has a row per other source of the language (none if it is alone),
    part ``term`` the ``top_terms`` kept terms by which a source stands out from
    its language. Ranks go by falling value, ties by the item's bytes.

    Null lang, source and text are empty strings; a source without terms, or of
    a language without kept terms, has pairs and no term; repeated rows are
    documents of their own; texts of any length are read whole; no documents, no
    rows. Other columns are ignored. The sources with their totals reach the
    driver and all tasks: as many rows as the root of the number of pairs returned.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_column, "lang"), (source_column, "source"), (text_column, "text"))])
    kept = written(kept_terms(texts, least_docs), "terms")
    counts = written(kept.select("lang", "term", F.col("n").alias("total"), F.explode("by").alias("by")).select(
        "lang", "term", "total", F.col("by.source").alias("source"), F.col("by.n").alias("n")), "counts")
    size = F.col("V").cast("decimal(20,0)")
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("n").alias("N"))
    sources = texts.groupBy("lang", "source").agg(F.lit(1).alias("_")).select("lang", "source").join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(langs, "lang", "left")
    sources = written(sources.select(
        "lang", "source", F.coalesce("V", F.lit(0)).alias("V"),
        (F.coalesce("own", F.lit(0)) + F.coalesce("V", F.lit(0))).alias("own_total"),
        (F.coalesce("N", F.lit(0)) + F.coalesce("V", F.lit(0))).alias("total")), "sources")
    groups = [(r["lang"], r["source"], r["own_total"]) for r in sources.select("lang", "source", "own_total").collect() if r["own_total"]]

    # part pair: all kept terms as if absent from both, then the terms of one, then those of both
    left = sources.select("lang", "source", "V", F.col("own_total").alias("_left"))
    right = sources.select("lang", F.col("source").alias("item"), F.col("own_total").alias("_right"))
    p, q = (share(F.lit(0), F.greatest(c, F.lit(1))) for c in ("_left", "_right"))
    none = left.join(right, "lang").where("source <> item").withColumn("_p", p).withColumn("_q", q).select(
        "lang", "source", "item", (F.expr("(_p - _q) * (_p - _q) div _q").cast("decimal(38,0)") * size).alias("value"))
    shape = "lang string, source string, item string, value long"
    some = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).mapInArrow(partial(_one, groups=groups), shape)
    both = kept.select("lang", "by").mapInArrow(partial(_both, groups=groups), shape)
    pairs = none.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    for more in (some, both):
        pairs = pairs.unionByName(more.withColumn("value", F.col("value").cast("decimal(38,0)")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    # part term: only terms that a source has, against its language
    terms = counts.withColumnRenamed("total", "lang_n").join(sources, ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("own_total")).alias("_p"),
                         share(F.col("lang_n"), F.col("total")).alias("_q")).where("_p > _q")
    terms = terms.select("lang", "source", "item", F.expr("(_p - _q) * (_p - _q) div _q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", place).select(*columns).unionByName(terms.select(*columns))
