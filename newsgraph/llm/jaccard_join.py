"""N-gram Jaccard self-join by universe partition and pigeonhole.

Two sets link when 100 * |intersection| >= threshold * |union|. Such sets
differ in at most H tokens, H the smaller size times (100 - t) / t. The token
universe is cut by hash into segments, as many as the size band of the smaller set
needs. A segment is indexed by its subset (weight 1: linked sets can agree on
it) or by its subset and its one-deletion neighbourhood (weight 2: they can be
one token apart). By pigeonhole, linked sets share a key on some segment of any
selection of weight H + 1. Per band, costs decide between the subsets of all
segments and deletions on half as many, from the keys of a bounded sample of its sets.

Every set picks its own selection. Segments on which it shares a key with no other
set cost nothing: a set that has H + 1 of these is alone and leaves. The others
add their cheapest segments, by the sets that are left. A linked pair
meets in the selections of both its sets, so it is enough to look from the
cheaper one: members of a large group of near copies that differ from it a little
select the rare keys of their differences, not the keys that the group shares.

Where sets meet, all are first compared with one of them, that with the
dearest selection (the centre of a group of copies), by count sketches and then exactly. Sets of one component need
no comparison any more; the rest of a group is compared by blocks, by sizes and
count sketches first, then exactly. No link between different sets escapes, and
a group that is one component is never compared all against all.

Sets are 64-bit shingle hashes, equal sets are one class with a 64-bit key; two
different shingles or sets count as one with a chance below their squared number / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.llm.common import Written, small, written
from newsgraph.llm.components import components
from newsgraph.llm.shingles import mix, shingle_set

#: Members of a group that are compared together; larger groups are compared by pairs of such blocks.
BLOCK = 512
#: Buckets of the count sketch, whose distance bounds the set distance from below.
SKETCH = 256
#: Sets per band whose keys the cost plan looks at, and the index rows that meeting a set counts
#: for (a comparison of two sketches inside a task takes about as long as a row on its way there).
SAMPLE, CANDIDATE_ROWS = 512, 1
#: Bands below this one are planned.
PLANNED = 8
#: Classes a task remembers, so that copies in it give their keys once.
REMEMBERED = 1 << 20
FLUSH_ROWS = 200_000


def _slack(size, threshold: int):
    """The most tokens in which a set of this size and a larger linked one differ."""
    return size * (100 - threshold) // threshold


def _band(size: int, threshold: int) -> int:
    """Size band: sets of band b need a selection of weight 2^b + 1 to 2^(b+1)."""
    return _slack(size, threshold).bit_length() - 1


def _key(tokens: np.ndarray, seed: int) -> np.int64:
    return np.int64(mix(mix(tokens, seed).sum(keepdims=True) + np.uint64(tokens.size)).view(np.int64)[0])


def _profiles(batches, width: int, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(text)]
        yield pa.RecordBatch.from_arrays([
            batch.column(ids),
            pa.array([s.size for s in sets], pa.int64()),
            pa.array([_key(s, 11) for s in sets], pa.int64()),
        ], ["doc_id", "n", "class"])


def segment_keys(tokens: np.ndarray, band: int, deletions: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, segments) of a set under a band's partition of the universe, of weight 2^(band+1) in all."""
    m = 2 ** band if deletions else 2 ** (band + 1)
    place = (mix(tokens, 100 + band) & np.uint64(m - 1)).astype(np.int64)
    value = mix(tokens, 7)
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, place, value)
    sizes = np.bincount(place, minlength=m).astype(np.uint64)
    where = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40), 5)
    keys, segments = mix(sums + mix(sizes, 3) + where), np.arange(m)
    if deletions:
        less = mix(sums[place] - value + mix(sizes[place] - np.uint64(1), 3) + where[place])
        keys, segments = np.concatenate([keys, less]), np.concatenate([segments, place])
    return keys.view(np.int64), segments


def _index(batches, width: int, threshold: int, plan: dict[int, bool], text: str) -> Iterator[pa.RecordBatch]:
    """(sig, class, own, segment, n): the keys of every set. ``own`` marks the
    partition of the set's band; a set that can link with smaller ones of the band
    below has keys under that one as well."""
    seen: set[int] = set()
    out: list[tuple[np.ndarray, np.ndarray, int, bool, int]] = []
    held = 0

    def flush():
        sizes = [k.size for k, *_ in out]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([o[0] for o in out])), pa.array(np.repeat(np.array([o[2] for o in out], np.int64), sizes)),
            pa.array(np.repeat(np.array([o[3] for o in out], bool), sizes)),
            pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)),
            pa.array(np.repeat(np.array([o[4] for o in out], np.int64), sizes)),
        ], ["sig", "class", "own", "segment", "n"])

    for batch in batches:
        for value in batch.column(text):
            tokens = shingle_set(value.as_py(), width)
            key = int(_key(tokens, 11)) if _slack(tokens.size, threshold) else 0
            if not key or key in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            band = _band(tokens.size, threshold)
            bands = [(band, True)]
            least = -(-tokens.size * threshold // 100)
            if _slack(least, threshold) and _band(least, threshold) < band:
                bands.append((band - 1, False))
            for b, own in bands:
                keys, segments = segment_keys(tokens, b, plan.get(b, False))
                out.append((keys, segments, key, own, tokens.size))
                held += keys.size
            if held >= FLUSH_ROWS:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def _both_ways(batches, width: int, threshold: int, text: str) -> Iterator[pa.RecordBatch]:
    """(band, deletions, class, n, segment, sig) of sampled sets under either way of indexing."""
    for batch in batches:
        for value in batch.column(text):
            tokens = shingle_set(value.as_py(), width)
            if not _slack(tokens.size, threshold):
                continue
            band, key = _band(tokens.size, threshold), _key(tokens, 11)
            for deletions in (False, True):
                keys, segments = segment_keys(tokens, band, deletions)
                n = keys.size
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, band, np.int32)), pa.array(np.full(n, deletions)), pa.array(np.full(n, key)),
                    pa.array(np.full(n, tokens.size)), pa.array(segments.astype(np.int32)), pa.array(keys),
                ], ["band", "deletions", "class", "n", "segment", "sig"])


def plan_bands(source: DataFrame, classes: DataFrame, width: int, threshold: int) -> dict[int, bool]:
    """Per band: whether one-deletion neighbourhoods on half as many segments
    cost less than plain subsets.

    Costs are index rows, and the sets that a set meets on the shared segments
    that it has to select, as the keys of ``SAMPLE`` sets of the band let expect
    of all its sets. Bands from ``PLANNED`` on have plain subsets: a deletion per
    token costs more than any selection there. The plan changes the cost, not
    the result."""
    banded = classes.where(_slack_of(F.col("n"), threshold) > 0).withColumn("band", _band_of(F.col("n"), threshold))
    banded = banded.where(F.col("band") < PLANNED)
    totals = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    turn = F.row_number().over(Window.partitionBy("band").orderBy("class"))
    # at most SAMPLE rows per band below PLANNED
    chosen = F.broadcast(banded.withColumn("_turn", turn).where(F.col("_turn") <= SAMPLE).select("doc_id"))
    keys = source.join(chosen, "doc_id", "left_semi").select("text").mapInArrow(
        partial(_both_ways, width=width, threshold=threshold, text="text"),
        "band int, deletions boolean, class long, n long, segment int, sig long")
    way = ["band", "deletions"]
    segments = keys.withColumn("meets", F.count("*").over(Window.partitionBy(*way, "sig")) - 1).groupBy(
        *way, "class", "n", "segment").agg(F.count("*").alias("rows"), F.sum("meets").alias("meets"))
    weight = F.when(F.col("deletions"), 2).otherwise(1)
    shared = F.count_if(F.col("meets") > 0)
    sets = segments.groupBy(*way, "class", "n").agg(
        F.sum("rows").alias("rows"), shared.alias("shared"), F.sum("meets").alias("meets"))
    total = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("band") + 1)
    need = _slack_of(F.col("n"), threshold) + 1 - (total - F.col("shared") * weight)
    found = sets.withColumn("met", F.when(need > 0, need / weight * F.col("meets") / F.col("shared")).otherwise(0.0)).groupBy(
        *way).agg(F.sum("rows").alias("rows"), F.sum("met").alias("met"), F.count("*").alias("sets")).collect()
    cost = {(r["band"], r["deletions"]): (r["rows"] + CANDIDATE_ROWS * r["met"] * totals[r["band"]] / r["sets"]) / r["sets"] for r in found}
    return {b: cost[b, True] < cost[b, False] for b, deletions in cost if deletions}


def _slack_of(n: Column, threshold: int) -> Column:
    return F.call_function("div", n * (100 - threshold), F.lit(threshold))


def _band_of(n: Column, threshold: int) -> Column:
    return F.length(F.bin(_slack_of(n, threshold))) - 1


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` whose key two sets have, one of them in its own band.

    Nearly all keys belong to one set. Every row crosses the one exchange by key
    once and the index is not written: what comes out is all that is kept of it."""
    by = Window.partitionBy("sig")
    met = {"_a": F.min("class").over(by), "_b": F.max("class").over(by), "_own": F.max("own").over(by)}
    return rows.withColumns(met).where("_a <> _b and _own").drop(*met)


def _survivors(rows: DataFrame, threshold: int, plan: dict[int, bool]) -> DataFrame:
    """``rows`` of the sets that may have a partner, with ``weight`` of the
    segment and ``need``: the weight to select among the shared segments. ``rows``
    are partitioned by class and own, so nothing here moves them."""
    band = _band_of(F.col("n"), threshold) - F.when(F.col("own"), 0).otherwise(1)
    weight = F.when(band.isin([b for b, deletions in plan.items() if deletions]), 2).otherwise(1)
    total = F.call_function("shiftleft", F.lit(1).cast("long"), (band + 1).cast("int"))
    most = F.when(F.col("own"), _slack_of(F.col("n"), threshold)).otherwise(total - 1)
    segments = rows.select("class", "own", "n", "segment").distinct().withColumn("weight", weight)
    need = most + 1 - (total - F.sum("weight"))
    kept = segments.groupBy("class", "own", "n").agg(need.alias("need")).where("need > 0").drop("n")
    return rows.join(kept, ["class", "own"]).withColumn("weight", weight)


def _selected(rows: DataFrame) -> DataFrame:
    """(sig, class, own, n, probe, cost): ``probe`` marks the keys of the
    segments that a set selects, ``cost`` the sets it meets there."""
    counts = rows.groupBy("sig").agg((F.count("*") - 1).alias("meets"))
    # one exchange: all that follows goes by class and own
    priced = rows.join(small(counts, 24), "sig").repartition("class", "own")
    segments = priced.groupBy("class", "own", "segment").agg(
        F.sum("meets").alias("meets"), F.first("weight").alias("weight"), F.first("need").alias("need"))
    by = Window.partitionBy("class", "own")
    before = F.coalesce(F.sum("weight").over(by.orderBy("meets", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = segments.withColumn("probe", before < F.col("need")).withColumn(
        "cost", F.sum(F.when(F.col("probe"), F.col("meets"))).over(by))
    return priced.join(chosen.select("class", "own", "segment", "probe", "cost"), ["class", "own", "segment"]).select(
        "sig", "class", "own", "n", "probe", "cost")


def _sets(batches, width: int, text: str) -> Iterator[pa.RecordBatch]:
    """The sets of wanted classes; a repeated id whose text is of another class gives none."""
    for batch in batches:
        sets = [shingle_set(t.as_py(), width) for t in batch.column(text)]
        keep = pa.array([_key(s, 11) == c for s, c in zip(sets, batch.column("class").to_pylist(), strict=True)],
                        pa.bool_())
        yield pa.RecordBatch.from_arrays([
            batch.column("class").filter(keep),
            pa.array([s.tobytes() for s in sets], pa.binary()).filter(keep),
            pa.array([np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH), 255
                                 ).astype(np.uint8).tobytes() for s in sets], pa.binary()).filter(keep),
        ], ["class", "tokens", "sketch"])


def _linked(batches, threshold: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets link, compared exactly."""
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            x, y = np.frombuffer(ta.as_buffer(), np.uint64), np.frombuffer(tb.as_buffer(), np.uint64)
            common = np.intersect1d(x, y, assume_unique=True).size
            keep.append(100 * common >= threshold * (x.size + y.size - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], ["a", "b"])


def _alike(batches) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are no further apart than those of linked sets, ``most``."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
                for c in ("sketch_a", "sketch_b"))
        keep = pa.array(np.abs(x - y).sum(1) <= batch.column("most").to_numpy(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], ["a", "b"])


def _compare(rows: list[pa.RecordBatch], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of one block pair that sizes, sketches and components cannot rule out."""
    table = pa.Table.from_batches(rows)
    get = lambda c: table.column(c).to_numpy()
    classes, n, cost, component, block = get("class"), get("n"), get("cost"), get("component"), get("block")
    own, probe = get("own"), get("probe")
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    order = np.lexsort((classes, cost))  # the cheaper set of a pair looks
    rank = np.empty(order.size, np.int64)
    rank[order] = np.arange(order.size)
    a, b = [], []
    for x in np.flatnonzero(probe):
        may = (rank > rank[x]) & (component != component[x]) & (own | own[x])
        if low != high:
            may &= block != block[x]
        may &= 100 * np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x])
        y = np.flatnonzero(may)
        if y.size:
            most = (100 - threshold) * (n[y] + n[x]) // (100 + threshold)
            y = y[np.abs(sketches[y] - sketches[x]).sum(1) <= most]
            a.append(np.full(y.size, classes[x]))
            b.append(classes[y])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def _block_pairs(batches, threshold: int) -> Iterator[pa.RecordBatch]:
    """Candidates of the block pairs, whose rows come one after the other."""
    held: list[pa.RecordBatch] = []
    key = None

    def done():
        a, b = _compare(held, threshold)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "low", "high")], 1)
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if held and key != tuple(keys[i]):
                yield done()
                held = []
            key = tuple(keys[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield done()


def linked_classes(source: DataFrame, classes: DataFrame, width: int, threshold: int,
                   plan: dict[int, bool] | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links of classes, enough of them to connect what is linked.

    ``source`` has (doc_id, text), ``classes`` (class, doc_id, n)."""
    if plan is None:
        plan = plan_bands(source, classes, width, threshold)
    # what every set has, and of that what two sets share
    index = source.select("text").mapInArrow(
        partial(_index, width=width, threshold=threshold, plan=dict(plan), text="text"),
        "sig long, class long, own boolean, segment int, n long")
    shared = Written(_shared(index), "shared")
    rows = shared.df.repartition("class", "own").dropDuplicates(["sig", "class", "own"])
    left = Written(_survivors(rows, threshold, plan), "survivors")
    shared.drop()
    chosen = Written(_selected(left.df), "selected")
    left.drop()

    groups = chosen.df.groupBy("sig").agg(F.max(F.struct("own", "cost", "class", "n")).alias("centre"), F.max("probe").alias("_any")).where(
        "_any and centre.own")
    groups = written(groups.select("sig", F.col("centre.class").alias("centre"), F.col("centre.n").alias("centre_n")), "centres")
    near = f"100 * least(n, centre_n) >= {threshold} * greatest(n, centre_n)"
    stars = chosen.df.join(small(groups, 40), "sig").where("class <> centre").where(near).select(
        F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b"),
        F.expr(f"{100 - threshold} * (n + centre_n) div {100 + threshold}").alias("most")).distinct()
    wanted = written(chosen.df.select("class").distinct().join(classes.select("class", "doc_id"), "class"), "wanted")
    sets = written(
        source.join(small(wanted, 32), "doc_id").select("class", "text")
        .mapInArrow(partial(_sets, width=width, text="text"), "class long, tokens binary, sketch binary")
        .dropDuplicates(["class"]), "sets")

    def joined_with(pairs: DataFrame, column: str) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(sets.select(F.col("class").alias(c), F.col(column).alias(f"{column}_{c}")), c)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        return written(joined_with(pairs, "tokens").mapInArrow(partial(_linked, threshold=threshold), "a long, b long"), "links")

    # most sets are far from a centre: whole sets travel only where their sketches are near
    first = verified(written(joined_with(stars, "sketch").mapInArrow(_alike, "a long, b long"), "stars"))
    joined = components(first, "a", "b").select(F.col("node").alias("class"), "component")
    members = written(chosen.df.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")), "members")
    chosen.drop()
    # keys where sets of several components meet
    open_keys = members.groupBy("sig").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b"), F.max("probe").alias("_any"), F.count("*").alias("_n"),
    ).where("_a <> _b and _any").select("sig", F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    dealt = members.join(small(written(open_keys, "open"), 24), "sig").withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    shape = dealt.join(sets.select("class", "sketch"), "class")
    shape = shape.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    more = verified(written(shape.mapInArrow(partial(_block_pairs, threshold=threshold), "a long, b long").distinct(), "pairs"))
    return first.unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80,
                    id_column: str = "doc_id", text_column: str = "text",
                    plan: dict[int, bool] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Sets of distinct ``width``-word shingles of the lower-cased (A-Z) whole
    text; a text with fewer words is one shingle. Documents link when their sets
    have a Jaccard similarity of ``threshold`` percent or more; component_id is
    the smallest id reachable. Null, empty and blank texts have no shingle and
    link with nothing. Repeated rows come back as often as they are. A null id
    is a row of its own component (null) and represents no class unless it is
    the only member. Texts of any length are compared whole. Other columns are
    ignored. ``plan`` and ``block`` (deletions per band, members compared
    together) change the cost, not the result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    profiles = written(
        source.mapInArrow(partial(_profiles, width=width, ids="doc_id", text="text"),
                          "doc_id long, n long, class long"), "profiles")
    classes = written(
        profiles.where("n > 0").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n")),
        "classes")
    links = linked_classes(source, classes, width, threshold, plan, block)
    named = [classes.select(F.col("class").alias(c), F.col("doc_id").alias(f"doc_{c}")) for c in "ab"]
    edges = links.join(named[0], "a").join(named[1], "b").select("doc_a", "doc_b")
    joined = components(edges, "doc_a", "doc_b")
    label = classes.select("class", "doc_id").join(
        joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    ).select("class", F.coalesce("component", "doc_id").alias("component_id"))
    # only classes with more than one member or a link need a label by join
    changed = profiles.where("n > 0").groupBy("class").agg(F.count("*").alias("c")).where("c > 1").select("class").union(
        joined.select(F.col("node").alias("doc_id")).join(classes, "doc_id").select("class")).distinct()
    label = label.join(changed, "class", "left_semi")
    own = F.col("n") > 0
    return profiles.select("doc_id", "n", F.when(own, F.col("class")).alias("class")).join(
        label, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
