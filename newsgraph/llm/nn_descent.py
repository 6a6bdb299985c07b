"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node (its members are kept aside), so copies cost nothing
in the graph. The graph starts from exact neighbours inside blocks of vectors
that are close in random orders, and improves by rounds: every node proposes its
neighbours, forward and reverse, to each other. Queries walk the graph from a
few entry nodes, always expanding the best nodes not yet expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsgraph.llm.common import Written, running_sum, written

DEGREE = 24          # neighbours per node in the graph
REVERSE = 24         # reverse neighbours that take part in a round, the nearest first
PROPOSALS = 6        # neighbours that a node proposes to one neighbour in a round
ORDERS = 4           # random orders of the start
BLOCK = 1024         # nodes of a block of the start
ROUNDS = 5           # rounds at most; fewer once less than SETTLED of the edges change
SETTLED = 0.01
BEAM = 96            # nodes kept per query
EXPAND = 64          # nodes expanded per query and step
ENTRIES = 256        # entry nodes; a bounded table
BITS = 16            # sign bits of a random order


#: Nearness of what is no neighbour at all.
FAR = -1e30


def _codes(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _units(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.float32).reshape(len(codes), -1).astype(np.float64)


def _nearness(x: np.ndarray) -> np.ndarray:
    """Minus the squared distance of all rows from each other, the diagonal FAR.

    It orders as the cosine does, but of near copies the cosine has only the last
    digits; around their mean the differences keep theirs."""
    x = x - x.mean(0)
    square = (x * x).sum(1)
    near = np.minimum(2 * (x @ x.T) - square[:, None] - square[None], 0)
    np.fill_diagonal(near, FAR)
    return near


def _coded(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            x = np.array(batch.column("vector").to_pylist(), np.float64).reshape(n, -1)
            codes = pa.array([c.tobytes() for c in _codes(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), codes], ["node", "code"])


def _ordered(batches, orders: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Sort keys of every node in every random order: sign bits of random
    directions, then the place along one more direction."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = _units(batch.column("code").to_pylist())
        keys = []
        for order in range(orders):
            plane = np.random.default_rng(1000 + order).normal(size=(x.shape[1], bits + 1)).astype(np.float32)
            side = x @ plane
            key = np.zeros(n, np.int64)
            for b in range(bits):
                key = key << 1 | (side[:, b] > 0)
            keys.append(key << 32 | ((np.clip(side[:, bits], -8, 8) + 8) / 16 * 0x7FFFFFFF).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(batch.column("node").to_numpy(), orders)),
             pa.array(np.repeat(np.arange(orders, dtype=np.int32), n)), pa.array(np.concatenate(keys))],
            ["node", "tree", "key"])


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float32())])


def _lists(column) -> Iterator[tuple[np.ndarray, pa.StructArray]]:
    ends = column.offsets.to_numpy()
    values = column.values
    for a, b in zip(ends, ends[1:], strict=False):
        yield values.slice(a, b - a)


def _nearest_in_block(batches, degree: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in _lists(batch.column("members")):
            ids = group.field("node").to_numpy()
            if ids.size < 2:
                continue
            x = _units(group.field("code").to_pylist())
            sims = _nearness(x)
            k = min(degree, ids.size - 1)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(ids, k)), pa.array(ids[best.ravel()]),
                pa.array(np.take_along_axis(sims, best, 1).ravel().astype(np.float32))], schema=EDGE)


def _proposed(batches, proposals: int) -> Iterator[pa.RecordBatch]:
    """For every two neighbours u, v of a node: (u, v) if v is nearer to u than
    the worst that u has, the best ``proposals`` of them."""
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for group in _lists(batch.column("members")):
            ids = group.field("node").to_numpy()
            k = min(proposals, ids.size - 1)
            if k < 1:
                continue
            x = _units(group.field("code").to_pylist())
            sims = _nearness(x)
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(sims, best, 1)
            good = value > group.field("worst").to_numpy()[:, None]
            u, at = np.nonzero(good)
            out.append((ids[u], ids[best[u, at]], value[u, at].astype(np.float32)))
            held += u.size
            if held > 100_000:
                yield _edges(out)
                out, held = [], 0
    if out:
        yield _edges(out)


def _edges(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], schema=EDGE)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every u, ties to the smaller v."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def build_graph(nodes: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, proposals: int = PROPOSALS,
                orders: int = ORDERS, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, sim, rank): the graph over nodes (node, code)."""
    keys = nodes.mapInArrow(partial(_ordered, orders=orders, bits=BITS), "node long, tree int, key long")
    placed = running_sum(keys.withColumn("one", F.lit(1)), ["key", "node"], "one", "place", "tree").select(
        "node", "tree", F.floor(F.col("place") / block).alias("block"))
    blocks = placed.join(nodes, "node").groupBy("tree", "block").agg(
        F.collect_list(F.struct("node", "code")).alias("members"))
    schema = "u long, v long, sim float"
    graph = Written(_top(blocks.mapInArrow(partial(_nearest_in_block, degree=degree), schema), degree), "graph")
    count = graph.df.count()
    for _ in range(rounds):
        worst = graph.df.groupBy("u").agg(
            F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(FAR).cast("float")).alias("worst"))
        back = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
        backward = graph.df.withColumn("back", back).where(F.col("back") <= reverse).select(
            F.col("v").alias("center"), F.col("u").alias("node"))
        around = graph.df.select(F.col("u").alias("center"), F.col("v").alias("node")).union(backward).distinct()
        known = nodes.join(worst.withColumnRenamed("u", "node"), "node", "left").select(
            "node", "code", F.coalesce("worst", F.lit(FAR).cast("float")).alias("worst"))
        # a node has at most degree + reverse neighbours here
        groups = around.join(known, "node").groupBy("center").agg(
            F.collect_list(F.struct("node", "code", "worst")).alias("members"))
        proposed = groups.select("members").mapInArrow(partial(_proposed, proposals=proposals), schema)
        better = _top(graph.df.select("u", "v", "sim").union(proposed), degree)
        step = Written(better, "graph")
        same = step.df.join(graph.df.select("u", "v"), ["u", "v"], "left_semi").count()
        new = step.df.count() - same
        graph.drop()
        graph = step
        if new <= SETTLED * count:
            break
    return graph.df


def _scored(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (_units(batch.column(c).to_pylist()) for c in ("query_code", "code"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("node"), pa.array((-((a - b) ** 2).sum(1)).astype(np.float32))],
                ["query", "node", "sim"])


def search_graph(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, expand: int = EXPAND,
                 entries: int = ENTRIES, reverse: int = REVERSE) -> DataFrame:
    """(query, node, sim): the nodes a greedy search ends with, ``beam`` per query.

    ``queries``: (query, code, own). A search starts at the entry nodes nearest to
    the query and at its own node. A step expands the ``expand`` best of the
    beam that are not expanded yet; it ends when the whole beam is.
    """
    back = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    links = written(
        graph.select("u", "v").union(
            graph.withColumn("back", back).where(F.col("back") <= reverse).select("v", "u")).distinct(), "links")
    schema = "query long, node long, sim float"
    score = lambda pairs: pairs.join(queries.select("query", F.col("code").alias("query_code")), "query").join(
        nodes, "node").select("query", "query_code", "node", "code").mapInArrow(_scored, schema)
    doors = nodes.select("node", "code").orderBy(F.xxhash64("node"), "node").limit(entries)
    # a stated, bounded set of entries against all queries
    seen = queries.select("query", F.col("code").alias("query_code")).join(F.broadcast(doors)).mapInArrow(_scored, schema)
    own = queries.select("query", F.col("own").alias("node"), F.lit(0.0).cast("float").alias("sim"))
    first = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    state = Written(seen.union(own).groupBy("query", "node").agg(F.max("sim").alias("sim")).withColumn(
        "rank", F.row_number().over(first)).where("rank <= 8").select("query", "node", "sim", F.lit(False).alias("done")), "beam")
    while True:
        turn = F.row_number().over(Window.partitionBy("query").orderBy("done", F.desc("sim"), "node"))
        now = written(state.df.withColumn("now", ~F.col("done") & (turn <= expand)), "turn")
        front = now.where("now").select("query", F.col("node").alias("u"))
        if front.isEmpty():
            return now.select("query", "node", "sim")
        found = front.join(links, "u").select("query", F.col("v").alias("node")).distinct().join(
            now.select("query", "node"), ["query", "node"], "left_anti")
        merged = now.select("query", "node", "sim", (F.col("done") | F.col("now")).alias("done")).union(
            score(found).withColumn("done", F.lit(False)))
        step = Written(merged.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= beam).drop("rank"), "beam")
        state.drop()
        state = step


def _exact(batches) -> Iterator[pa.RecordBatch]:
    """Cosines in double precision of the original vectors."""
    for batch in batches:
        if batch.num_rows:
            n = batch.num_rows
            a, b = (np.array(batch.column(c).to_pylist(), np.float64).reshape(n, -1) for c in ("query_vector", "vector"))
            # only components whose squares leave the range of doubles are scaled
            a, b = (np.where((t := np.abs(x).max(1, keepdims=True)) > 1e150, x / t, np.where(t < 1e-150, x / t, x)) for x in (a, b))
            score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)],
                                             ["query", "node", "score"])


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id",
                       vector_column: str = "embedding", **graph_options) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by
    ``every`` its ``k`` nearest other rows by cosine, nearest first, ties to the
    smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do those whose length differs from the commonest one
    (ties: the smaller), nor rows with a null id. Rows equal in id and vector count once. A
    row is represented by its node; of equal vectors only the k + 1 smallest ids
    can be among anyone's k nearest. Other columns are ignored. Scores are exact;
    the search is approximate (recall against brute force: see the README).
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).where(
        F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.where(F.size("vector") == F.lit(lengths["length"] if lengths else -1))
    # bit-equal vectors: hashed first, so that long arrays are compared within a hash only
    same = Window.partitionBy("hash", "vector").orderBy("id")
    members = written(
        rows.withColumn("hash", F.xxhash64("vector")).dropDuplicates(["id", "hash"])
        .withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1), "members")
    heads = written(members.where("at = 1").select(F.col("id").alias("node"), "hash", "vector"), "heads")
    nodes = written(heads.select("node", "vector").mapInArrow(_coded, "node long, code binary"), "nodes")
    queries = written(rows.where(F.col("id") % every == 0).select(
        F.col("id").alias("query"), F.col("vector").alias("query_vector")).dropDuplicates(["query"]), "queries")
    codes = queries.select(F.col("query").alias("node"), F.col("query_vector").alias("vector")).mapInArrow(
        _coded, "node long, code binary").withColumnRenamed("node", "query")
    node_of = queries.withColumn("hash", F.xxhash64("query_vector")).join(heads, "hash").where(
        F.col("query_vector") == F.col("vector")).select("query", F.col("node").alias("own"))
    coded = written(codes.join(node_of, "query"), "query_codes")
    graph = build_graph(nodes, **graph_options)
    found = search_graph(coded, nodes, graph)
    near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    kept = found.withColumn("near", near).where(F.col("near") <= 8 * (k + 1)).select("query", "node")
    exact = kept.join(heads.select("node", "vector"), "node").join(queries, "query").select(
        "query", "node", "query_vector", "vector").mapInArrow(_exact, "query long, node long, score double")
    head_of = members.select("id", "hash", "vector").join(
        heads.select(F.col("node"), F.col("hash").alias("h"), F.col("vector").alias("w")),
        (F.col("hash") == F.col("h")) & (F.col("vector") == F.col("w"))).select("node", "id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return exact.join(head_of, "node").where(F.col("id") != F.col("query")).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
