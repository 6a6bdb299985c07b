"""Picked elements of landed pages as a stored table that is looked up by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from newsgraph.operators.elements import PICKED
from newsgraph.sinks.key_layout import RANGE_ROWS
from newsgraph.sinks.store import StarStore

TABLE = "picked"
SCHEMA = StructType([StructField("url", StringType()), StructField("landed_at", TimestampType()), StructField("picks", PICKED)])


class PickedPages:
    """The versions of all pages with their picked elements, laid out by address.

    A lookup opens only the files that can hold one of its addresses, so article,
    author, profile and beat pages of a few items cost a few files of a large table.
    """

    def __init__(self, spark: SparkSession, root: str, range_rows: int = RANGE_ROWS):
        self.store = StarStore(spark, root, {TABLE: SCHEMA}, {TABLE: ("url",)}, range_rows)

    def add(self, picks: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Store the elements of newly landed pages; a batch of a stream that was stored before is skipped."""
        load = self.store.begin()
        if source is not None and load.done_before(source, batch):
            return 0
        rows = load.add(TABLE, picks)
        load.commit(source, batch)
        return rows

    def lookup(self, links: DataFrame) -> DataFrame:
        """The stored rows that can belong to the addresses in ``url``."""
        return self.store.matching(TABLE, links, ["url"])

    def read(self) -> DataFrame:
        return self.store.read(TABLE)
