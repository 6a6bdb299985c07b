"""WARC archives of pages, and the merged index of their captures."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.llm.common import small, written

#: Payloads from this size on are stored once.
LEAST_REVISIT = 1000
#: Uncompressed payload bytes of one archive file.
ARCHIVE_BYTES = 32 << 20
#: Index rows of one merge task.
MERGE_ROWS = 200_000
#: Without a column for it a capture's time is this many seconds after 2024 began, by its id.
SECONDS = 10 * 365 * 86_400

CAPTURE = ("page_id long, url_key string, captured_at timestamp, file string, file_offset long, file_length long, "
           "record_type string, payload_digest string, run long")


def url_key(url: Column) -> Column:
    """Sort key of an address: host labels reversed and comma-joined, then ``)``
    and the rest without fragment; null for null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"),
                    F.regexp_replace(rest, r"(?s)^[^/?]*", ""))


def with_revisits(pages: DataFrame, least: int, id_column: str, url: str, html: str,
                  captured_at: Column | None) -> DataFrame:
    """page_id, url, html, digest, bytes, captured_at, and refers_to: the largest
    page id with an equal payload of ``least`` bytes or more, if it is another."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    at = captured_at if captured_at is not None else F.timestamp_seconds(
        F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col(id_column).cast("long"), F.lit(0)), F.lit(SECONDS)))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
        at.alias("captured_at"))
    last = written(rows.where(F.col("bytes") >= least).groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    return rows.join(small(last, 80), "digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))).drop("last")


def file_system(target: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(file system, path) for a folder as Spark names it."""
    for spark, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "/dbfs/"), ("wasbs://", "abfss://")):
        if target.startswith(spark):
            target = arrow + target.removeprefix(spark)
    return pyarrow.fs.FileSystem.from_uri(target)


def _record(page: dict) -> bytes:
    """One WARC record, compressed as a gzip member of its own."""
    revisit = page["refers_to"] is not None
    body = b"" if revisit else page["html"].encode("utf-8", "surrogatepass")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {page['captured_at'].strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{page['digest']}", f"X-Payload-Length: {page['bytes']}",
        f"Content-Length: {len(body)}"]
    if page["page_id"] is not None:
        lines.append(f"X-Page-ID: {page['page_id']}")
    if page["url"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(page["url"].split()))
    if revisit:
        lines += [f"X-Refers-To-Page-ID: {page['refers_to']}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return gzip.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def _write(batches, target: str, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes archives and yields their captures, one sorted run per archive.

    A file is named by this attempt of the task alone; only the files of the
    attempt whose rows Spark keeps are in the index.
    """
    fs, root = file_system(target)
    fs.create_dir(root, recursive=True)
    task, n = TaskContext.get(), 0
    stream = None
    rows: list[tuple] = []

    def close():
        nonlocal stream
        stream.close()
        stream = None
        rows.sort(key=lambda r: (r[1] is not None, r[1] or "", r[2], r[0] is not None, r[0] or 0))
        kinds = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("captured_at", pa.timestamp("us", "UTC")),
                           ("file", pa.string()), ("file_offset", pa.int64()), ("file_length", pa.int64()),
                           ("record_type", pa.string()), ("payload_digest", pa.string()), ("run", pa.int64())])
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)
        rows.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for page in batch.slice(at, 64).to_pylist():
                if stream is None:
                    name = f"{task.partitionId():05d}-{n:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    run, n, offset, held = task.partitionId() << 20 | n, n + 1, 0, 0
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = _record(page)
                stream.write(data)
                rows.append((page["page_id"], page["url_key"], page["captured_at"], name, offset, len(data),
                             "response" if page["refers_to"] is None else "revisit", page["digest"], run))
                offset, held = offset + len(data), held + page["bytes"]
                if held >= run_bytes:
                    yield close()
    if stream is not None:
        yield close()


def write_archives(pages: DataFrame, target: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES,
                   id_column: str = "page_id", url: str = "url", html: str = "html",
                   captured_at: Column | None = None) -> DataFrame:
    """Writes one record per page into ``target`` (a folder all executors share)
    and returns the captures, in locally sorted runs (one per archive)."""
    rows = with_revisits(pages, least, id_column, url, html, captured_at).withColumn("url_key", url_key(F.col("url")))
    return written(rows.mapInArrow(partial(_write, target=target, run_bytes=archive_bytes), CAPTURE), "captures")


PASSED = ("url_key", "captured_at", "position", "history_no")
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url_key string, captured_at timestamp, position long, history_no long")


def _parsed(data: bytes, name: str) -> tuple:
    """page id, payload bytes, digest, type and page referred to, of one record."""
    record = gzip.decompress(data)
    head_end = record.index(b"\r\n\r\n")
    first, *lines = record[:head_end].decode("utf-8", "surrogatepass").split("\r\n")
    head = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
    end = head_end + 4 + int(head["Content-Length"])
    if first != "WARC/1.1" or record[end:] != b"\r\n\r\n":
        raise ValueError(f"not a record in {name}")
    body = record[head_end + 4:end]
    revisit = head["WARC-Type"] == "revisit"
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    if not revisit and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
        raise ValueError(f"a payload of {name} is not as written")
    page = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
    return page, size, digest, head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if revisit else None


def _read(batches, target: str) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(target)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    opened, stream = None, None
    for batch in batches:
        rows = []
        for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "file_offset", "file_length")),
                                        strict=True):
            if name != opened:
                if stream:
                    stream.close()
                opened, stream = name, fs.open_input_file(f"{root}/{name}")
            stream.seek(offset)
            rows.append(_parsed(stream.read(length), name))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), *(batch.column(c) for c in PASSED)],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *PASSED])
    if stream:
        stream.close()


def read_archives(index: DataFrame, target: str) -> DataFrame:
    """The records that the index names, each read at its place in its archive;
    payloads are held against their digests."""
    return (
        index.select("file", "file_offset", "file_length", *PASSED)
        .repartition("file").sortWithinPartitions("file", "file_offset")
        .mapInArrow(partial(_read, target=target), RECORD))


class LoserTree:
    """Merges k sorted iterators: an inner node holds the loser of its match, so
    a new row replays only the path from its leaf to the root."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, k = runs, key, len(runs)
        self.rows = [next(r, None) for r in runs]
        self.keys = [None if r is None else key(r) for r in self.rows]
        self.losers = [-1] * k
        self.winner = -1
        for leaf in range(k):
            self._replay(leaf, first=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; ended runs go last, ties to the smaller run."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int, first: bool = False) -> None:
        node, here = (leaf + len(self.runs)) // 2, leaf
        while node:
            other = self.losers[node]
            if other < 0 and first:
                self.losers[node] = here
                return
            if self._beats(other, here):
                self.losers[node], here = here, other
            node //= 2
        self.winner = here

    def __iter__(self):
        while self.runs and self.rows[self.winner] is not None:
            w = self.winner
            yield self.rows[w]
            self.rows[w] = next(self.runs[w], None)
            self.keys[w] = None if self.rows[w] is None else self.key(self.rows[w])
            self._replay(w)


def _sort_key(row: tuple):
    url, at, page = row[1], row[2], row[0]
    return (url is not None, url or "", at is not None, at or 0, page is not None, page or 0)


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """The rows of one key range, run after run, merged by (key, time, id)."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    table = table.combine_chunks()
    columns = [table.column(c).to_pylist() for c in ("page_id", "url_key", "captured_at")]
    runs = table.column("run").to_pylist()
    starts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]

    def rows_of(a: int, b: int):
        for i in range(a, b):
            yield (columns[0][i], columns[1][i], columns[2][i].timestamp() if columns[2][i] else None, i)

    merged = LoserTree([rows_of(a, b) for a, b in zip(starts, starts[1:], strict=False)], _sort_key)
    out = table.take(pa.array([r[3] for r in merged], pa.int64()))
    out = out.append_column("place", pa.array(range(out.num_rows), pa.int64()))
    yield from out.to_batches(max_chunksize=10_000)


def merge_index(captures: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The captures of all runs in one global order: (url_key, captured_at,
    page_id), nulls first, with ``position`` from 0 and ``history_no``, the number
    of a capture among those of its address, from 1.

    The runs are cut at common range boundaries; a task merges the slices of all
    runs in its range with a loser tree. The boundaries go by the whole sort key,
    so a frequent address is spread; a task holds about ``merge_rows`` index rows.
    """
    rows = captures.count()
    order = ["url_key", "captured_at", "page_id"]
    merged = written(
        captures.repartitionByRange(max(1, -(-rows // merge_rows), min(rows, 8)), *order, "file_offset", "run")
        .sortWithinPartitions("run", *order)
        .mapInArrow(_merge, CAPTURE + ", place long").withColumn("part", F.spark_partition_id()), "merged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per merge task
    offsets = merged.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = merged.join(F.broadcast(offsets), "part").withColumn("position", F.col("place") + F.col("offset"))
    first = placed.groupBy("url_key").agg(F.min("position").alias("first"))
    return placed.join(first, placed["url_key"].eqNullSafe(first["url_key"])).drop(first["url_key"]).withColumn(
        "history_no", F.col("position") - F.col("first") + 1).drop("part", "place", "first")


def archive_round_trip(pages: DataFrame, target: str, **options) -> DataFrame:
    """One row per page read back from the archives, with its place in the merged index.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    position, history_no. A null html is an empty payload, a null url has a null
    key, a null page id refers to the largest id of its payload if there is one. Rows with equal payloads and the
    same largest id are all responses. Repeated rows have a record each. Other
    columns are ignored.
    """
    return read_archives(merge_index(write_archives(pages, target, **options)), target)
