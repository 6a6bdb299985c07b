"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.llm.common import written

#: Bits by which a probe interval is refined per round: 2^bits - 1 probes in it.
STEP_BITS = 8
#: Allowed miss of a splitter, in hundredths of a shard's bytes.
TOLERANCE = 2
#: Wanted text bytes of an exchange bin (shards are sorted bin by bin), and the most bins.
BIN_BYTES = 16 << 20
MOST_BINS = 2400


def _unsigned(column: Column) -> Column:
    """A 64-bit value moved so that its order is that of unsigned prefixes."""
    return column.bitwiseXOR(F.lit(-(1 << 63)))


def splitters(rows: DataFrame, key: str, tie: str, size: str, targets: list[int], slack: int) -> list[tuple[int, int]]:
    """For every target a boundary (key, tie), such that the bytes of the rows
    below it (by key, then tie, both as unsigned 64-bit) miss the target by
    ``slack`` at most, or by one (key, tie) value.

    Each round sums the exact bytes between evenly spaced probes of every
    interval that still holds a target, over all partitions; the driver gets one
    number per probe (at most 2^STEP_BITS for each target). A boundary inside
    the bytes of one key is refined on the tie.
    """
    out: dict[int, tuple[int, int]] = {}
    # an open interval: (prefix value, bits known of the 128, bytes below it) -> targets in it
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, list(range(len(targets))))}
    while open_:
        depth = next(iter(open_))[1]
        column = _unsigned(F.col(key if depth < 64 else tie))
        shift = 64 - STEP_BITS - depth % 64
        probe = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << STEP_BITS) - 1))
        if depth == 0:
            known = F.lit("0")
        elif depth < 64:
            known = F.shiftrightunsigned(column, 64 - depth).cast("string")
        else:
            rest = F.shiftrightunsigned(column, 128 - depth).cast("string") if depth > 64 else F.lit("0")
            known = F.concat_ws("/", _unsigned(F.col(key)).cast("string"), rest)
        names = {_name(prefix, depth): prefix for prefix, _ in open_}
        found = rows.withColumn("_known", known).where(F.col("_known").isin(list(names))).groupBy(
            "_known", probe.alias("_probe")).agg(F.sum(size).alias("_bytes")).collect()
        bytes_of: dict[int, dict[int, int]] = {}
        for r in found:
            bytes_of.setdefault(names[r["_known"]], {})[r["_probe"]] = r["_bytes"]
        after: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (prefix, _), (below, wanted) in open_.items():
            for t in wanted:
                low = below
                for probe_at in range(1 << STEP_BITS):
                    high = low + bytes_of.get(prefix, {}).get(probe_at, 0)
                    if high >= targets[t] or probe_at == (1 << STEP_BITS) - 1:
                        break
                    low = high
                done = depth + STEP_BITS
                here = prefix << STEP_BITS | probe_at
                if targets[t] - low <= slack and targets[t] - low <= abs(high - targets[t]):
                    out[t] = _boundary(here, done)
                elif abs(high - targets[t]) <= slack or done == 128:
                    out[t] = _boundary(here + 1, done)
                else:
                    after.setdefault((here, done), (low, []))[1].append(t)
        open_ = after
    return [out[t] for t in range(len(targets))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _name(prefix: int, depth: int) -> str:
    """How the rows of an interval show the bits known of them."""
    if depth <= 64:
        return str(prefix) if depth < 64 else f"{_signed(prefix)}/0"
    return f"{_signed(prefix >> (depth - 64))}/{prefix & ((1 << (depth - 64)) - 1)}"


def _boundary(prefix: int, depth: int) -> tuple[int, int]:
    """(key, tie) of the first value with this prefix; key 2^64 is past the end."""
    whole = prefix << (128 - depth)
    return whole >> 64, whole & ((1 << 64) - 1)


def _placed(cuts: list[tuple[int, int]]):
    """A vectorised function: the number of boundaries at or below (key, tie)."""
    inside = [c for c in cuts if c[0] < 1 << 64]
    keys = np.array([_signed(c[0] ^ (1 << 63)) for c in inside], np.int64)
    ties = np.array([_signed(c[1] ^ (1 << 63)) for c in inside], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(low < high):  # boundaries inside the rows of one key
            low[i] += np.searchsorted(ties[low[i]:high[i]], t[i], "right")
        return pd.Series(low.astype(np.int32))

    return place


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: int = TOLERANCE, bin_bytes: int = BIN_BYTES,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``.

    Rows are sorted by (hash of the text, id) and cut into shards of near equal
    bytes (UTF-8 bytes of the text plus 8): equal texts are neighbours, and a
    cut goes through a group of them only where no cut beside it is within
    ``tolerance`` percent of a shard. ``slot`` counts the rows of a shard from 0
    in that order. Boundaries come from exact byte counts below probes; then one
    exchange sorts the rows, in bins of about ``bin_bytes``. A null text has 8
    bytes and the crc of no byte. Rows equal in text and id stay together, in an
    order of their own; a null id sorts as the smallest. Empty tables give no
    rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = written(docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("_tie")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(MOST_BINS // shards, -(-total // (shards * bin_bytes))))
    bins = shards * per_shard
    targets = [total * i // bins for i in range(1, bins)]
    slack = total * tolerance // (100 * bins)
    cuts = sorted(splitters(rows, "_key", "_tie", "size", targets, slack)) if total else []
    placed = rows.withColumn("bin", _placed(cuts)("_key", "_tie"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bin").agg(F.count("*").alias("_n")).withColumn(
        "shard", F.floor(F.col("bin") / per_shard).cast("int")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("bin").orderBy("_key", "_tie")
    return placed.withColumn("_at", F.row_number().over(order) - 1).join(
        F.broadcast(offsets), "bin").select(  # one row per bin
        "doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_at")).cast("long").alias("slot"))
