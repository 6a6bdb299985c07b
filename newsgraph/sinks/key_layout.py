"""Physical layout of stored tables that are looked up by key.

A segment of such a table is cut into ranges of the key's 64-bit hash, one
folder per range, each range sorted by the hash and carrying a parquet bloom
filter on it. The manifest lists the ranges of every segment, so a batch opens
only the folders that can hold one of its keys, and inside those Spark skips
row groups by the pushed-down hashes. Hashes only choose files: lookups still
compare the keys themselves.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

HASH, RANGE = "key_hash", "key_range"
#: Rows for which one range of a segment is meant, and the most ranges of a segment (as a power of two).
RANGE_ROWS, MOST_BITS = 1_000_000, 12
#: A batch with more distinct keys reads the whole table: it would open most files anyway.
LOOKUP_KEYS = 10_000
#: Hashes that are pushed down one by one; of more only the smallest and the largest are.
PUSHED_KEYS = 500


def key_hash(*keys: Column | str) -> Column:
    return F.xxhash64(*keys)


def range_bits(rows: int, range_rows: int = RANGE_ROWS) -> int:
    """Bits of the hash that name the range, for a segment of so many rows."""
    return min(MOST_BITS, max(0, -(-rows // range_rows) - 1).bit_length())


def range_of(hashed: int, bits: int) -> int:
    """The range of a signed 64-bit hash."""
    return (hashed & (1 << 64) - 1) >> (64 - bits)


def hashed_schema(schema: StructType) -> StructType:
    return StructType([*schema, StructField(HASH, LongType())])


def write_ranges(df: DataFrame, hashed: Column, path: str, rows: int, bits: int) -> None:
    """Write ``df`` with its hash, one folder per range."""
    place = F.shiftrightunsigned(F.col(HASH), 64 - bits).cast("int") if bits else F.lit(0)
    laid_out = df.withColumn(HASH, hashed).withColumn(RANGE, place)
    if bits:  # one task per range; a small segment stays in the partitions it has
        laid_out = laid_out.repartition(2**bits, RANGE)
    (
        laid_out.sortWithinPartitions(RANGE, HASH)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{HASH}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{HASH}", str(max(1, min(rows, RANGE_ROWS))))
        .partitionBy(RANGE)
        .parquet(path)
    )


def matching_folders(segment: dict, hashes: Iterable[int]) -> list[str]:
    """Folders of a segment that can hold one of the hashes."""
    if "ranges" not in segment:
        return [segment["path"]]
    wanted = {range_of(h, segment["bits"]) for h in hashes}
    return [f"{segment['path']}/{RANGE}={r}" for r in segment["ranges"] if r in wanted]


def batch_hashes(batch: DataFrame, keys: Iterable[Column | str], most: int = LOOKUP_KEYS) -> list[int] | None:
    """The distinct key hashes of a batch, ``most`` at most; None if there are more."""
    rows = batch.select(key_hash(*keys).alias(HASH)).distinct().limit(most + 1).collect()
    return None if len(rows) > most else [r[HASH] for r in rows]
