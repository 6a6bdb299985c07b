"""Packing of documents into sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsgraph.llm.common import Written, running_sum
from newsgraph.llm.shingles import mix
from newsgraph.llm.tokens import token_rows, unpacked

DIMENSIONS = 4
#: Bits of the curve per dimension; together below the 63 bits of a key.
BITS = 12


class Projection:
    """A document's hashed token vector, projected to a few dimensions.

    Every id has a fixed random sign vector (from a hash); the projection is
    their sum over the log-scaled counts of the ids, divided by the vector's
    length. So equal mixes of tokens are neighbours, whatever their length.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def __call__(self, ids: np.ndarray) -> list[float]:
        kinds, counts = np.unique(ids[:-1], return_counts=True)
        if not kinds.size:
            return [0.0] * self.dimensions
        weight = np.log1p(counts.astype(np.float64))
        signs = (mix(kinds.astype(np.uint64), 21)[:, None] >> np.arange(self.dimensions, dtype=np.uint64)) & np.uint64(1)
        at = ((signs.astype(np.float64) * 2 - 1) * weight[:, None]).sum(0)
        return (at / np.sqrt((weight ** 2).sum())).tolist()


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows), by Skilling's
    transform: undo the rotations from the top bit down, Gray-decode, interleave."""
    x = cells.astype(np.int64).T.copy()
    n = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keys(batches, bits: int, reach: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = np.array(batch.column("vector").to_pylist(), np.float64)
            cells = np.clip((v + reach) / (2 * reach) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            keys = pa.array(hilbert_keys(cells, bits), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_tokens")), keys],
                                             ["row", "doc_id", "n_tokens", "key"])


def _pieces(batches, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows: list[tuple] = []
            part = batch.slice(at, 256)
            for doc, ids, first, key in zip(*(part.column(c).to_pylist() for c in
                                              ("doc_id", "ids", "position", "key")), strict=True):
                found = unpacked(ids)
                start = 0
                while start < found.size:
                    offset = (first + start) % length
                    end = min(found.size, start + length - offset)
                    rows.append((doc, start, end - start, zlib.crc32(found[start:end].tobytes()), found.size,
                                 (first + start) // length, offset, key))
                    start = end
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(8)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"])


def pack_along_curve(docs: DataFrame, path: str, length: int = 1024, end: int = 0, dimensions: int = DIMENSIONS,
                     bits: int = BITS, reach: float = 12.0, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key.

    Documents (their ids and the end id) are ordered by the Hilbert key of their
    projected token vector, ties by id, and laid end to end; every ``length``
    ids are a sequence, so documents are cut at sequence ends only and only the
    last sequence can be short. Null and empty texts are the end id alone.
    Repeated rows are packed as often as they are. Other columns are ignored.
    """
    rows = Written(token_rows(docs, path, end, id_column, text_column, Projection(dimensions))
                   .withColumn("row", F.monotonically_increasing_id()), "tokens")
    keyed = rows.df.select("row", "doc_id", "n_tokens", "vector").mapInArrow(
        partial(_keys, bits=bits, reach=reach), "row long, doc_id long, n_tokens long, key long")
    placed = running_sum(keyed, ["key", "doc_id"], "n_tokens", "position").select("row", "position", "key")
    return rows.df.select("row", "doc_id", "ids").join(placed, "row").mapInArrow(
        partial(_pieces, length=length),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "curve_key long")
