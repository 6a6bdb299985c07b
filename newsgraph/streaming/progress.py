"""Start, progress, pause and end of every cycle as a written table."""

from __future__ import annotations

import datetime as dt
import json
import logging
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from newsgraph.staging import hadoop_fs
from newsgraph.streaming.cycle import OBSERVED

log = logging.getLogger(__name__)

SCHEMA = "at timestamp, event string, query string, run string, name string, batch long, rows long, seconds double, message string"


class CycleLog(StreamingQueryListener):
    """Appends an event to the table below ``root`` for all that happens to a query.

    One small file per event and one folder per day, written by the driver
    without a job, so an event is on record as soon as it has happened.
    ``compact_days`` makes one file of the days that are over.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.names: dict[str, str] = {}
        self._ended: dict[str, threading.Event] = {}

    def _write(self, event: str, query, run, **more) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        row = {"at": now.isoformat(), "event": event, "query": str(query), "run": str(run), "name": self.names.get(str(query))} | more
        fs, path = hadoop_fs(self.spark, f"{self.root}/day={now:%Y-%m-%d}/{now:%H%M%S%f}-{uuid.uuid4().hex[:8]}.json")
        out = fs.create(path, False)
        try:
            out.write(bytearray((json.dumps(row) + "\n").encode("utf-8")))
        finally:
            out.close()
        log.info("cycle %s %s %s", row["name"], event, more)

    def _end_of(self, run) -> threading.Event:
        return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self._write("start", event.id, event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        self._write("progress", p.id, p.runId, batch=p.batchId, rows=p.numInputRows if seen is None else seen["rows"],
                    seconds=p.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        self._write("pause", event.id, event.runId)

    def onQueryTerminated(self, event) -> None:
        self._write("end", event.id, event.runId, message=event.exception)
        self._end_of(event.runId).set()

    def wait_for_end(self, run, seconds: float = 60) -> bool:
        """Wait until the end of a query run is on record; events arrive after the query has ended."""
        return self._end_of(run).wait(seconds)


def watch(spark: SparkSession, root: str) -> CycleLog:
    listener = CycleLog(spark, root)
    spark.streams.addListener(listener)
    return listener


def read_cycles(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, day date").json(root)


def compact_days(spark: SparkSession, root: str, today: dt.date) -> list[str]:
    """Make one file of every day before ``today``; returns the days."""
    fs, folder = hadoop_fs(spark, root)
    done = []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if not name.startswith("day=") or name.removeprefix("day=") >= today.isoformat():
            continue
        files = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().endswith(".json")]
        if len(files) > 1:
            rows = spark.read.schema(SCHEMA).json([f.toString() for f in files])
            # a crash before the files go doubles events, it loses none
            rows.coalesce(1).write.mode("append").option(
                "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/{name}")
            for file in files:
                fs.delete(file, False)
            done.append(name.removeprefix("day="))
    return sorted(done)
