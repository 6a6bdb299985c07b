"""The endless cycle as a micro-batch stream.

New landed files become one micro-batch every ten seconds. Rows whose key came
before are known from Spark's state store and leave the stream there; the stored
tables decide about the others, and a batch that was committed before a failure
is skipped when it is replayed.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsgraph.plans.crawl import pick_pages
from newsgraph.plans.load import load_records
from newsgraph.sinks.store import StarStore
from newsgraph.sources.feeds import split_rejects
from newsgraph.sources.picked import PickedPages
from newsgraph.staging import scope, stage

log = logging.getLogger(__name__)

CYCLE_SECONDS = 10
OBSERVED = "cycle"


def pick_stream(
    pages: DataFrame, path: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """Keep the picked-elements table up to date: every page is read once, when
    it lands. ``spark.read.parquet(path)`` gives the table."""
    return (
        pick_pages(pages)
        .writeStream.queryName("pages")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(once))
        .start()
    )


def _trigger(once: bool) -> dict:
    return {"availableNow": True} if once else {"processingTime": f"{CYCLE_SECONDS} seconds"}


def store_picks(
    pages: DataFrame, table: PickedPages, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """``pick_stream`` into a table that is looked up by address."""

    def add(batch: DataFrame, batch_id: int, source: str) -> None:
        with scope(table.store.spark):
            table.add(stage(pick_pages(batch), "picked"), source, batch_id)
            table.store.tidy()

    return _each_batch(pages.writeStream.queryName("pages").option("checkpointLocation", checkpoint), add, "pages", once)


def _each_batch(writer, work: Callable[[DataFrame, int, str], None], name: str, once: bool) -> StreamingQuery:
    """Start a stream whose batches are worked on under the query id that the checkpoint keeps."""
    started, source = threading.Event(), []

    def run(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        work(batch, batch_id, source[0])

    query = writer.trigger(**_trigger(once)).foreachBatch(run).start()
    source.append(f"{name}:{query.id}")
    started.set()
    return query


def unseen(stream: DataFrame, keys: Sequence[str], event_time: str | None = None, forget_after: str | None = None) -> DataFrame:
    """The first row of every key, by Spark's keyed state; what has no key as
    a reject of its feed.

    With ``event_time`` and ``forget_after`` (such as "3 days") keys leave the
    state again, and a row that comes later than that is decided by the stored tables.
    """
    rejected = "reject_reason" in stream.columns
    if rejected:  # rejects are told apart by feed and text
        stream = stream.withColumn("_rejected", F.when(F.col("reject_reason").isNotNull(), F.struct("feed", "reject_text")))
    by = [*keys, *(["_rejected"] if rejected else [])]
    if forget_after:
        first = stream.withWatermark(event_time, forget_after).dropDuplicatesWithinWatermark(by)
    else:
        first = stream.dropDuplicates(by)
    return first.drop("_rejected")


def run_cycles(
    stream: DataFrame,
    store: StarStore,
    checkpoint: str,
    to_records: Callable[[DataFrame], DataFrame],
    *,
    name: str = "cycle",
    once: bool = False,
    keys: Sequence[str] | None = None,
    event_time: str | None = None,
    forget_after: str | None = None,
    **load_options,
) -> StreamingQuery:
    """Start the stream. ``once`` works off what has landed and stops.

    ``keys`` name the columns that make a row the same as an earlier one in all
    that the load stores: such rows are dropped by the state of the stream
    (``unseen``), so a cycle that brings nothing new reads no stored table.
    Rejects of the feeds (``keep_rejects``) are stored and counted by the load.

    A batch counts as loaded before only for the query id that the checkpoint
    keeps: with another checkpoint Spark numbers batches from 0 again.
    """
    if keys:
        stream = unseen(stream, keys, event_time, forget_after)
    stream = stream.observe(OBSERVED, F.count(F.lit(1)).alias("rows"))

    def load(batch: DataFrame, batch_id: int, source: str) -> None:
        with scope(store.spark):
            # the state is asked once: the batch is written before it is read several times
            rows, rejects = split_rejects(stage(batch, "cycle"))
            load_records(
                store, to_records(rows), rejects=rejects, source=source, source_batch=batch_id, **load_options
            )
            store.tidy()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    return _each_batch(writer, load, name, once)


def keep_running(
    start: Callable[[], StreamingQuery],
    *,
    pause: float = CYCLE_SECONDS,
    restarts: int | None = None,
) -> None:
    """Wait for the stream and start it again after a failure, for ever unless
    ``restarts`` bounds it. The checkpoint makes it go on where it failed."""
    failures = 0
    while True:
        try:
            start().awaitTermination()
            return
        except StreamingQueryException as error:
            failures += 1
            if restarts is not None and failures > restarts:
                raise
            log.warning("cycle failed, restart in %s s: %s", pause, error)
            time.sleep(pause)
