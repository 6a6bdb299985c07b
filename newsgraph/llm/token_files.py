"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A block holds whole documents. Ids are replaced by their rank in the corpus
(most frequent first), so most take one byte. The bytes of the ranks and the
control bytes are separate: a control byte has two bits for each of four ranks,
their byte count less one. Decoding looks up a control byte's lengths and
offsets in a table of 256 rows and gathers all ranks of a block at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.common import Written, running_sum
from newsgraph.llm.tokens import token_rows, unpacked

MAGIC = b"NGT1"
#: A block is closed when it holds this many ids; a longer document is one block.
BLOCK_IDS = 1 << 16
#: Documents whose ids are counted at once.
COUNTED_TOGETHER = 256

#: For each control byte: the byte counts of its four values, and their sum.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-v.size // 4) * 4, np.uint8)
    codes[:v.size] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    keep = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back: lengths by table, starts by a running sum, one gather."""
    if not count:
        return np.empty(0, "<u4")
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    word = (raw[start].astype(np.uint32) | raw[start + 1].astype(np.uint32) << 8
            | raw[start + 2].astype(np.uint32) << 16 | raw[start + 3].astype(np.uint32) << 24)
    return (word & MASKS[size - 1]).astype("<u4")


def write_block(doc_ids: list[int | None], sizes: list[int], ranks: np.ndarray) -> bytes:
    """Magic, counts, document ids with a null mark, sizes, control bytes, data bytes."""
    control, data = encode_values(ranks)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = struct.pack("<4sIIQQ", MAGIC, len(doc_ids), ranks.size, len(control), len(data))
    return head + ids.tobytes() + null.tobytes() + np.array(sizes, "<u4").tobytes() + control + data


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, sizes, ranks) of a block."""
    magic, docs, count, n_control, n_data = struct.unpack_from("<4sIIQQ", block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize("<4sIIQQ")
    ids = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    ranks = decode_values(block[at:at + n_control], block[at + n_control:at + n_control + n_data], count)
    return [None if n else int(d) for d, n in zip(ids, null, strict=True)], sizes, ranks


def _count(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED_TOGETHER):
            part = batch.column("ids").slice(at, COUNTED_TOGETHER)
            found = np.bincount(np.concatenate([unpacked(data) for data in part.to_pylist()]), minlength=total.size)
            found[:total.size] += total
            total = found
    kinds = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(total[kinds], pa.int64())], ["id", "n"])


def rank_table(tokens: DataFrame) -> np.ndarray:
    """The ids by falling frequency over all documents, ties to the smaller id.

    Counted per task, summed by id. The driver gets a row per kind of id that
    occurs, at most the vocabulary of the tokenizer.
    """
    counts = tokens.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "id").toPandas()
    return rows["id"].to_numpy(np.uint32)


def _blocks(batches, order: np.ndarray, block_ids: int) -> Iterator[pa.RecordBatch]:
    rank_of = np.zeros(int(order.max()) + 1 if order.size else 1, "<u4")
    rank_of[order] = np.arange(order.size, dtype="<u4")
    docs: list[int | None] = []
    sizes: list[int] = []
    parts: list[np.ndarray] = []
    held = number = 0
    schema = pa.schema([("number", pa.int64()), ("block", pa.binary())])

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([write_block(docs, sizes, np.concatenate(parts))], pa.binary())],
            schema=schema)

    for batch in batches:
        for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            ranks = rank_of[unpacked(data.as_py())]
            docs.append(doc)
            sizes.append(ranks.size)
            parts.append(ranks)
            held += ranks.size
            if held >= block_ids:
                yield flush()
                docs, sizes, parts, held, number = [], [], [], 0, number + 1
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, target: str, path: str, end: int = 2,
                      block_ids: int = BLOCK_IDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes ``target/blocks`` (files in ascending order of document id, each a
    run of blocks) and ``target/ranks`` (the ids by rank)."""
    spark = docs.sparkSession
    tokens = Written(token_rows(docs, path, end, id_column, text_column), "tokens")
    order = rank_table(tokens.df)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(
        f"{target}/ranks")
    (
        tokens.df.select("doc_id", "ids", F.monotonically_increasing_id().alias("tie"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .mapInArrow(partial(_blocks, order=order, block_ids=block_ids), "number long, block binary")
        .write.option("compression", "uncompressed").parquet(f"{target}/blocks")
    )
    tokens.drop()


def _documents(batches, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("block"):
            docs, sizes, ranks = read_block(data.as_py())
            ids = order[ranks].astype("<u4")
            ends = np.cumsum(sizes.astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(sizes.astype(np.int64)),
                pa.array([zlib.crc32(ids[e - s:e].tobytes()) for s, e in zip(sizes, ends, strict=True)], pa.int64()),
                pa.array([ids[e - s:e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary()),
            ], ["doc_id", "n_tokens", "ids_crc32", "ids"])


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids) from the files; ids are little-endian
    unsigned 32-bit bytes. The rank table has a row per kind of id in the files."""
    ranks = spark.read.parquet(f"{target}/ranks").orderBy("rank").toPandas()
    return spark.read.parquet(f"{target}/blocks").select("block").mapInArrow(
        partial(_documents, order=ranks["id"].to_numpy(np.uint32)),
        "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, target: str, path: str, end: int = 2, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, all from the files.

    ``start`` counts the ids of all documents before it by id (nulls first, ties
    in an order of their own). Null and empty texts are the end id alone;
    repeated rows are written as often as they are; other columns are ignored.
    """
    write_token_files(docs, target, path, end, **options)
    found = read_token_files(docs.sparkSession, target).drop("ids")
    return running_sum(found, ["doc_id"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")
